import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hitflow.llm import personal_data as pii
from hitflow.llm import registry

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def plain(text):
    """The four patterns as they are, and their checks."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def card(rng, size=16):
    body = "".join(rng.choice("0123456789") for _ in range(size - 1))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def test_base_spans_match_the_patterns():
    rng = random.Random(7)
    alphabet = ["a", "B", "7", "12", "255", "300", ".", "@", "+", "-", " ", "(", ")", "_", "é", "\n", "x@y.z", "1.2.3.4", "+1 (555) 010-4477"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + rng.choice(("", card(rng), card(rng, 19)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("a@b.c_d@e.f", "a@@b.c", "1.2.3.4.5.6.7.8", "0001.1.1.255", "1.1.1.256", "+123456789012345678", "+1 2", "@b.c", "a@b", "a@b..c"):
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("unit", ["1", "a", "1.", "@", "a@", "a@b.", "+", "+1", "1 ", "(at)", ". "])
def test_long_texts_take_linear_time(unit):
    text = unit * (300_000 // len(unit))
    base = pii.base_spans(text)
    assert all(0 <= s < e <= len(text) for _, s, e in base)


def test_gradient_and_viterbi():
    rng = np.random.default_rng(3)
    words = [["kim", "[at]", "m.org"], ["+1", "555"], ["x", "9"], ["4"]]
    labels = [[1, 2, 2], [7, 8], [0, 5], [3]]
    c = pii.Chains(words)
    y = np.array([v for i in c.order for v in labels[i]])
    w, move = rng.normal(0, 0.3, (3, pii.WIDTH, len(pii.LABELS))), rng.normal(0, 0.3, (len(pii.LABELS),) * 2)
    value, gw, gm = pii.likelihood(c, y, w, move)
    for _ in range(25):
        o, f, k = rng.integers(3), int(rng.choice(c.features)), rng.integers(len(pii.LABELS))
        up = w.copy()
        up[o, f, k] += 1e-5
        assert abs((pii.likelihood(c, y, up, move)[0] - value) / 1e-5 - gw[o, f, k]) < 1e-3
        i, j = rng.integers(len(pii.LABELS), size=2)
        up = move.copy()
        up[i, j] += 1e-5
        assert abs((pii.likelihood(c, y, w, up)[0] - value) / 1e-5 - gm[i, j]) < 1e-3
    ban, first = pii._allowed()
    e = c.emissions(w)
    total, paths = 0.0, {}
    for place, i in enumerate(c.order):
        own = e[c.begin[place] : c.begin[place] + c.length[place]]
        every = {p: own[range(len(p)), p].sum() + first[p[0]] + sum(move[a, b] + ban[a, b] for a, b in itertools.pairwise(p)) for p in itertools.product(range(len(pii.LABELS)), repeat=len(own))}
        paths[i] = max(every, key=every.get)
        total += every[tuple(labels[i])] - np.log(np.exp(list(every.values())).sum())
    assert abs(total - value) < 1e-6
    assert [tuple(p) for p in pii.viterbi(c, {"w": w, "move": move})] == [paths[i] for i in range(len(words))]


def fixture(spark, seed, n, form=None):
    """Prose with personal data; with a form, in a writing that the patterns miss: rows and the spans so written."""
    rng = random.Random(seed)
    rows, planted = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        words[rng.randrange(40)] = str(rng.randint(0, 99999))
        words[rng.randrange(40)] = f"{rng.randint(1, 9)}.{rng.randint(1, 9)}"
        kind = rng.choice(pii.KINDS)
        value = {"email": f"{words[3]}.{rng.randint(0, 99)}@mail{rng.randint(1, 9)}.example.com", "ip": ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": card(rng), "phone": f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"}[kind]
        if form is not None:
            forms = pii.rewritten(kind, value)
            value = forms[form % len(forms)]
        at = rng.randint(5, 35)
        before = " ".join(words[:at]) + " "
        rows.append((i, before + value + " " + " ".join(words[at:])))
        planted.append((i, kind, len(before), len(before) + len(value)))
    return spark.createDataFrame(rows, "doc_id long, text string"), planted


def spans(row):
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in row.spans.split(",") if x)]


def test_field_finds_other_forms_and_leaves_clean_text(spark):
    df, _ = fixture(spark, 1, 900)
    model = pii.fit(pii.examples(df, per_kind=120))
    hit = total = wrong = 0
    for form in range(6):
        held, planted = fixture(spark, 100 + form, 150, form)
        got = {r.doc_id: spans(r) for r in pii.find(held, model).collect()}
        for i, kind, s, e in planted:
            total += 1
            hit += any(k == kind and a < e and s < b for k, a, b in got[i])
            wrong += sum(not (a < e and s < b) for _, a, b in got[i])
    assert hit >= 0.8 * total and wrong <= 0.01 * total, (hit, wrong, total)
    clean = spark.createDataFrame([(i, f"In {1900 + i} we sold {i * 37} of 12.5 kg (see page {i}) at 10:30, item {i}-{i + 4}.") for i in range(200)], "doc_id long, text string")
    assert [r for r in pii.find(clean, model).collect() if r.spans] == []


def test_query_matches_the_patterns(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op13_personal_data(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        got = spans(r)
        assert got == sorted(got, key=lambda s: (pii.KINDS.index(s[0]), s[1])) and set(base) <= set(got) and len(got) == len(base) + r.n_added


def test_rows_of_any_kind(spark):
    long = "x " * 200_000 + "kim@mail.org " + "7 " * 20_000
    rows = [(1, None), (2, ""), (None, "kim@mail.org"), (2, "kim@mail.org"), (2, "kim@mail.org"), (3, long), (4, "é世😀 1.2.3.4"), (5, "퟿ 9" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'z' as spans")
    model = pii.fit(pii.examples(fixture(spark, 1, 100)[0]))
    for m in (model, None):
        got = pii.find(df, m).collect()
        assert [(r.doc_id, r.n_email, r.n_ip) for r in got] == [(1, 0, 0), (2, 0, 0), (None, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 0), (4, 0, 1), (5, 0, 0)]
        assert got[0].spans == got[1].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[6].spans.startswith("ip:4:11")
        assert pii.find(df.where("false"), m).collect() == []
    assert pii.fit(pii.examples(df.where("doc_id < 3 and text is null"))) is None
