import hashlib
import random
import re

from tessera.llm import pii
from tessera.llm.pii import KINDS, find_pii, joined
from tests.llm.helpers import EDGE, docs, prose

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_spans(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def corpus():
    rng = random.Random(4)
    rows = []
    for d in range(400):
        w = prose(d, 40)
        for _ in range(rng.randint(0, 4)):
            n = "".join(rng.choice("0123456789") for _ in range(16))
            card = next(n[:-1] + c for c in "0123456789" if luhn(n[:-1] + c))
            w.insert(rng.randrange(len(w)), rng.choice(
                [f"a.b{n[:2]}@mail{n[0]}.example.com", f"{n[:3]}.{n[3:5]}.{n[5:7]}.{n[7]}", card, n, "1.2.3.4.5.6.7.8",
                 " ".join(card[i:i + 4] for i in range(0, 16, 4)), f"+1 ({n[:3]}) 555-{n[3:7]}", f"+1 ({n[:3]}) 555-{n[8:12]}",
                 f"+44 ({n[:3]}) 555-{n[8:12]}", f"+{n[:5]}", n[:7], "x@y@z.com", "a@b.c%d@e.f", f"00{n[0]}.1.1.255", "v1.2.3", "é@ü.de", "a@b..c", "+1-2 (",
                 "12 34-56  78"]))
        if d % 100 == 7:
            w.insert(9, f"({d}) 555-1234")
        rows.append((d + 100, " ".join(w)))
    return rows


def test_base_spans_match_brute_force_and_stay(spark):
    rows = corpus() + EDGE + [(60, "1" * 50_000), (61, "a" * 50_000 + "@"), (62, "a@" + "b." * 20_000 + "c"),
                              (63, "1 " * 30_000), (64, "\U0001f600 1.2.3.4 a@b.cd"), (65, "1.2.3.4" * 3)]
    got = find_pii(docs(spark, rows)).select("*", joined("base").alias("b"), joined("spans").alias("a")).collect()
    assert len(got) == len(rows)
    want = sorted(",".join(f"{k}:{s}:{e}" for k, s, e in slow_spans(t or "")) for _, t in rows)
    assert sorted(r.b for r in got) == want
    text = dict(rows)
    for r in got:
        base = slow_spans(text[r.doc_id] or "")
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in base) for k in KINDS]
        spans = [(x.kind, x.s, x.e) for x in r.spans]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
        extra = [x for x in spans if x not in base]
        assert all(x[2] <= y[1] or y[2] <= x[1] for x in extra for y in spans if x != y)
    shapes = {re.sub("[0-9]", "9", (text[r.doc_id])[x.s:x.e]) for r in got for x in r.spans if x not in r.base}
    assert "(999) 999-9999" in shapes, shapes  # a phone number the rule does not know


def test_added_spans_are_values_the_rules_miss(spark):
    """Values planted outside of the base patterns are found with few others."""
    rng = random.Random(8)
    rows, planted, misleading = [], set(), set()
    for i, (_, text) in enumerate(corpus() * 2):
        text, doc = f"{text} ", 1_000 + i
        if i % 8 < 4:
            n = "".join(rng.choice("0123456789") for _ in range(16))
            value, cue = [(f"({n[:3]}) 555-{n[3:7]}", "call"), (f"jane{n[:2]} (at) host{n[2]} (dot) example (dot) org", "or"),
                          ("3782 822463 10005", "amex"), (n[:-1] + next(c for c in "0123456789" if not luhn(n[:-1] + c)), "order")][i % 8]
            at = len(text) + len(cue) + 1
            text += f"{cue} {value} and so on"
            (misleading if i % 8 == 3 else planted).add((doc, at, at + len(value)))
        rows.append((doc, text))
    got = find_pii(docs(spark, rows)).collect()
    added = {(r.doc_id, x.s, x.e) for r in got for x in r.spans if x not in r.base}
    known = {(r.doc_id, m.start(), m.end()) for r in got for m in re.finditer(r"\([0-9]{3}\) 555-[0-9]{4}", dict(rows)[r.doc_id])}
    assert len(planted & added) >= 0.9 * len(planted), (len(planted & added), len(planted))
    assert len(added & (planted | known)) >= 0.8 * len(added)
    assert len(misleading & added) <= 0.1 * len(misleading)


def test_every_proposal_counts_in_the_model(spark, monkeypatch):
    """All proposals train, also where there are more than 20,000."""
    seen = []

    class Recorded(pii.GBTClassifier):
        def fit(self, rows):
            seen.append(rows.agg({self.getWeightCol(): "sum"}).first()[0] if self.isSet("weightCol") else rows.count())
            return super().fit(rows)

    monkeypatch.setattr(pii, "GBTClassifier", Recorded)
    text = "x 1.2.3.4 y 300.1.1.1 " * 50
    pii.fit(pii.with_proposals(docs(spark, [(i, text) for i in range(150)]), "doc_id", "text"), trees=1)
    # two generators each propose both addresses; none is told outside of a base span
    assert seen == [150 * 50 * 4]


def test_edges(spark):
    got = find_pii(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and all(r.spans == [] for r in got)
    assert find_pii(docs(spark, [])).count() == 0


def test_query_digest(spark):
    from tessera.llm.queries import pii_digest
    r = pii_digest(find_pii(docs(spark, [(1, "x 1.2.3.4 y@z.de")]))).first()
    assert r.spans == "email:10:16,ip:2:9" and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
