import hashlib
import random
import zlib

import duckdb
import pytest
from llm_fixtures import SF_MID

from crisismap.llm import merkle as M


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute(rows):
    """Trees, proofs and folds by plain loops."""
    sources = {}
    for r in rows:
        whole = [framed(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)]
        leaf = own = H("".join(whole))
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None:
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
            own = H("".join([*whole[:-1], framed(lower)]))
        sources.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf, own, r.doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    top, out = tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, (_, _, leaf, own, doc_id) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            proof, fold = "", own
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run, slot = level[at // 16 * 16:at // 16 * 16 + 16], at % 16
                    left, right = "".join(run[:slot]), "".join(run[slot + 1:])
                    proof, fold, at = proof + left + right, H(left + fold + right), at // 16
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], H(proof), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in M.manifest(docs).collect()), key=str)


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_MID}/documents.parquet'")
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = found(docs)
    assert got == sorted(con.execute(M.ORACLE["op12_merkle"]).fetchall(), key=str) == brute(docs.collect())
    assert {r[-1] for r in got} == {True, False}


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in all columns, ties, many small sources, one hot source with repeated rows, clashing names."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(0, 900, 7)]), rng.choice(["AbC", "", None, "É x"]), rng.choice(["en", None]),
             rng.choice(["a", "b", None, "Z", *[f"s{i}" for i in range(40)]]), rng.choice([1, None])) for _ in range(500)]
    rows += [(5, "T", "en", "hot", 1)] * 200 + [(i, "T" * 50_000 if i == 9 else "T", "en", "hot", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'x' AS pos", "'x' AS tree", "'x' AS leaf", "'x' AS `a.b`").repartition(5).cache()


def test_edges(odd, monkeypatch):
    monkeypatch.setattr(M, "RUNS_PER_COPY", 1)  # upper nodes in many copies
    assert found(odd) == brute(odd.collect())


@pytest.mark.parametrize("where", ["source = 'hot'", "doc_id IS NULL"])
def test_parts(odd, where):
    part = odd.where(where).cache()
    assert found(part) == brute(part.collect())


def test_one_row_and_none(odd):
    one = odd.where("source = 'hot'").limit(1).cache()
    assert found(one) == brute(one.collect()) and found(one)[0][4] == H("")
    assert found(odd.limit(0)) == []
