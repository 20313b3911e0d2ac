import itertools
import tempfile
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from llm_fixtures import SF_SMALL, edge, empty  # noqa: F401

from crisismap.llm import exact_dedup as E
from crisismap.llm import simhash as S
from crisismap.llm.components import components


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    want = sorted(con.execute(E.ORACLE["op4_exact_dedup"]).fetchall())
    got = E.op4_exact_dedup(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_all_white_space_is_ignored_in_sql_too(spark):
    rows = [(i, f"a{space}b") for i, space in enumerate(["", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x0e", "\x1f", "\u00a0", "\u2028"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = sorted(con.execute(E.ORACLE["op4_exact_dedup"]).fetchall())
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.dedup_report(docs).collect())
    assert got == want and [r[2] for r in got][:7] == [7] * 7


@pytest.mark.parametrize("memory", [1, 500, 1 << 20])
def test_grace_partitions_until_tables_fit(memory):
    rng = np.random.default_rng(1)
    contents = [bytes(rng.integers(97, 100, rng.integers(0, 5))) for _ in range(3000)]
    records = [(E.hashlib.sha256(c).digest(), c, (i,)) for i, c in enumerate(contents)]
    classes = defaultdict(set)
    for kind, (_, content, numbers) in E.grace(records, memory, tempfile.gettempdir()):
        classes[kind].add((content, numbers[0]))
    assert sum(map(len, classes.values())) == 3000
    assert len(classes) == len(set(contents))
    assert all(len({c for c, _ in members}) == 1 for members in classes.values())


def test_equal_digests_are_not_enough():
    same = b"\x00" * 32  # contents are compared, whatever their digests say
    kinds = [k for k, _ in E.grace([(same, b"a", (0,)), (same, b"b", (1,)), (same, b"a", (2,))], 1)]
    assert len(set(kinds)) == 2


@pytest.mark.parametrize("memory", [1, 64 << 20])
def test_exact_edges(edge, empty, memory):
    rows = E.dedup_report(edge, memory).collect()
    assert len(rows) == edge.count()
    by_text = defaultdict(list)
    for r in rows:
        by_text[r.text_sha256].append(r)
    assert all(sum(r.kept for r in group) == 1 for group in by_text.values())
    blank = next(g for g in by_text.values() if any(r.doc_id == 1 for r in g))
    assert {r.doc_id for r in blank} == {1, 2, 3} and {r.keep_id for r in blank} == {3}  # most code points
    same = next(g for g in by_text.values() if any(r.doc_id == 5 for r in g))
    assert len(same) == 3 and {r.keep_id for r in same} == {5}
    kept = E.drop_copies(edge, memory)
    assert kept.columns == edge.columns and kept.count() == len(by_text)
    assert E.dedup_report(empty).count() == E.drop_copies(empty).count() == 0


def brute_components(codes, limit):
    label = {c: c for c in codes}

    def find(c):
        while label[c] != c:
            c = label[c]
        return c

    for a, b in itertools.combinations(codes, 2):
        if bin(a ^ b).count("1") <= limit:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    groups = defaultdict(set)
    for c in codes:
        groups[find(c)].add(c)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("group_rows", [20_000, 20])
def test_links_equal_brute_force(spark, group_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(4)]
    ball = base[0] ^ rng.integers(0, 1 << 9, 200, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *near, ball, [0, 3]]).astype(np.uint64))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    root = {r.node: r.root for r in components(S.link_edges(df, 2, group_rows)).collect()}
    groups = defaultdict(set)
    for c in codes.view(np.int64).tolist():
        groups[root.get(c, c)].add(c & (1 << 64) - 1)
    assert {frozenset(g) for g in groups.values()} == brute_components(codes.tolist(), 2)


def test_index_bounds_its_frontier():
    rng = np.random.default_rng(4)
    codes = np.unique(np.uint64(7) ^ rng.integers(0, 1 << 12, 900, dtype=np.uint64))
    codes = codes[np.argsort(S.gray_rank(codes))]
    group = np.zeros(codes.size, np.int64)
    few = {p for a, b in S.GrayIndex(codes, group).near(2, frontier=1000) for p in zip(a.tolist(), b.tolist())}
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert few == {(i, j) for i, j in zip(*np.nonzero(apart <= 2)) if i < j}


def test_long_chain_is_one_component(spark):
    edges = spark.range(0, 300).selectExpr("id as u", "id + 1 as v")
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(edges.where("u < 0")).count() == 0


def test_fingerprint_by_definition():
    for text in ("", "one", "One two", "a b c d a b c", "ÀB x y z " * 9):
        tokens = text.encode().lower().split()
        shingles = [b" ".join(tokens[i:i + 3]) for i in range(max(1, len(tokens) - 2))] if tokens else []
        h = [S.xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert int(S.fingerprints([text])[0]) == want


def test_near_edges(edge, empty):
    rows = S.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fingerprint == "0" * 16
    assert by[4].component_id == by[5].component_id == 4
    kept = S.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(1) == 1 and 2 not in ids and None in ids
    assert S.near_duplicates(empty).count() == S.drop_near_duplicates(empty).count() == 0
