import hashlib
import math
import random
import re

from llm_fixtures import edge, empty  # noqa: F401
from pyspark.sql import functions as F

from crisismap.llm import pii as K

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PARTS = ["a@b.co", "x.y_z@h-1.d.e", ".", "..", "@", "1.2.3.4", "300.1.1.1", "0012.1.2.3", " ", "-", "4753376719988201",
         "4753 3767 1998 8201", "+1 (783) 555-5762", "+", "(", ")", "é", "😀", "\x01", "\x02", "12", "7", "%", "_",
         "a@b.com_c@d.org", "\n", "5555 5555-5555 4444", "Tel: 555-123-4567 ", "bob (at) site (dot) com", "4753.3767.1998.8201"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return [f"{list(BASE)[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_base_spans_by_definition(spark):
    random.seed(5)
    docs = [(i, "".join(random.choice(PARTS) for _ in range(random.randint(0, 14)))) for i in range(2000)]
    rows = K.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    for r in rows:
        want = base_spans(docs[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), docs[r.doc_id]
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
        order = [(int(s.split(":")[1]), K.KINDS.index(s.split(":")[0])) for s in r.spans.split(",") if s]
        assert order == sorted(order)
    assert any("phone" in r.spans and not r.n_phone for r in rows)  # spans that only the classifier adds


def plain_em(rows, rounds):
    """Posterior of each pattern and the labelers' reliabilities, written out over (kind, votes, n)."""
    p = [1 / (1 + math.exp(-sum(votes))) for _, votes, _ in rows]
    for _ in range(rounds):
        weight = [[n * (1 - q), n * q] for (_, _, n), q in zip(rows, p)]

        def total(y, want):
            return sum(w[y] for (kind, votes, _), w in zip(rows, weight) if want(kind, votes))

        def share(y, j, v):
            return (total(y, lambda _, votes: votes[j] == v) + 1) / (total(y, lambda *_: True) + 3)

        def odds(kind, votes):
            prior = (total(1, lambda k, _: k == kind) + 1) / (total(0, lambda k, _: k == kind) + 1)
            return math.log(prior) + sum(math.log(share(1, j, v) / share(0, j, v)) for j, v in enumerate(votes))

        right = [total(1, lambda _, v: v[j] == 1) + total(0, lambda _, v: v[j] == -1) for j in range(len(K.LABELERS))]
        spoken = [sum(total(y, lambda _, v: v[j] != 0) for y in (0, 1)) for j in range(len(K.LABELERS))]
        p = [1 / (1 + math.exp(-odds(kind, votes))) for kind, votes, _ in rows]
    return p, [(r + 1) / (s + 2) for r, s in zip(right, spoken)]


def test_em_equals_plain_sums(spark):
    rng = random.Random(2)
    rows = [(i % 4, [rng.choice((-1, 0, 1)) for _ in K.LABELERS], float(rng.randint(1, 50))) for i in range(60)]
    patterns = spark.createDataFrame([(i, kind, *votes, n) for i, (kind, votes, n) in enumerate(rows)],
                                     f"i int, kind int, {', '.join(f'{j} int' for j in K.LABELERS)}, n double").coalesce(1)
    for rounds in (1, 4):
        p, reliability = K._posterior(patterns, rounds)
        got = dict(patterns.select("i", p.alias("p")).collect())
        want, sure = plain_em(rows, rounds)
        assert all(abs(got[i] - q) < 1e-9 for i, q in enumerate(want))
        assert all(abs(reliability[j] - r) < 1e-9 for j, r in zip(K.LABELERS, sure))


def test_added_spans_are_those_the_classifier_takes(spark):
    random.seed(9)
    docs = spark.createDataFrame([(i, " ".join(random.choice(PARTS) for _ in range(8))) for i in range(400)], "doc_id long, text string")
    found = K.candidates(docs, "found")
    model = K.train(found, "found")
    added = 0
    for r in found.select("found", K.accepted(F.col("found"), model).alias("taken")).collect():
        base = [s for s in r.found if s.base]
        want = list(base)
        for s in r.found:
            logit = model.intercept + sum(w * (float(s.kind == K.KINDS.index(name[3:])) if name.startswith("is_") else s[name])
                                          for name, w in model.weights.items())
            if not s.base and 1 / (1 + math.exp(-logit)) >= K.ACCEPT_AT and all(s.end <= b.start or b.end <= s.start for b in base):
                want.append(s)
        assert sorted(map(tuple, r.taken)) == sorted(map(tuple, want))
        added += len(want) - len(base)
    assert added


def test_long_runs_end(spark):
    docs = [(1, "a" * 200_000), (2, "1 " * 50_000), (3, "9" * 100_000), (4, "+1" + " 2" * 30_000), (5, "a@b.cc " * 1500),
            (6, "a." * 50_000 + "@" + "b." * 30_000 + "c")]
    rows = {r.doc_id: r for r in K.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[5].n_email == 1500 and rows[6].n_email == 1 and rows[1].spans == ""


def test_edges(edge, empty):
    rows = K.report(edge).collect()
    assert len(rows) == edge.count()
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id in (1, 2, 3))
    clean = K.redact(edge)
    assert clean.columns == edge.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] is None and texts[2] == "" and "a.b@c-d.org" not in texts[6] and texts[6].count("[EMAIL]") == 400
    assert texts[6].count("[PHONE]") == 400
    assert K.report(empty).count() == K.redact(empty).count() == 0
