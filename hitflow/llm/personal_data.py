"""Personal data in texts: e-mail addresses, IP addresses, card and telephone numbers.

Base spans are those of four fixed patterns and their checks. A linear-chain conditional random field adds written forms that the
patterns do not know ("kim [at] mail [dot] org", "(555) 010-4477 20", cards in other groups).

The field's words are the runs of characters other than white space. A word is marked if it holds a digit, an @, or "at" or "dot" in
brackets; words within `REACH` of a marked one are open, and each maximal run of open words of a text is one chain (all other words
are outside of personal data by definition, so plain prose costs no more than finding marks). Labels are B and I of each kind and O.
Features of a word and of its two neighbours are its shape, its length, its punctuation, its digits and their checks, hashed to `WIDTH` places.

The field is trained on a small labelled table, `examples`: passages around base spans of a bounded sample of documents, labelled by
these spans, each also rewritten by rule into forms that the patterns miss, and passages with other numbers. Training
maximises the likelihood by forward and backward passes over all chains at once. Decoding is Viterbi over all chains of a block, one
numpy step per place in the chains. A decoded span counts if it overlaps no base span and passes its kind's check.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import prepare, saved
from .wordhash import blocks

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]
#: Documents sampled for the labelled table, and passages of it for each kind and without any.
SAMPLE_DOCS, PER_KIND = 20_000, 250
REACH = 3
WIDTH = 4096
CONTEXT = 60
_NEVER = -1e4

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address begins where the run of its characters before the @ does, or where the address before ends; so each character is looked at once or twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        while domain and start > free and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    found = [("email", *s) for s in _emails(text)]
    for r in _DOTTED.finditer(text):  # an address lies within one run of digits and dots
        if r[0].count(".") >= 3:
            found += [("ip", r.start() + m.start(), r.start() + m.end()) for m in _IP.finditer(r[0]) if _octets(m[0])]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _plausible(kind: str, text: str) -> bool:
    """The check of a decoded span."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        return bool(re.search(r"@|[\[({]\s*at\s*[\])}]", text, re.I) and re.search(r"\.|[\[({]\s*dot\s*[\])}]|\bdot\b", text, re.I))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(_octets(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def chains(texts: list[str]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(text number, [(start, end) of each word]) of each run of open words."""
    whole, first = "\n".join(texts), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], (c > 0x20) & (c != 0xA0), [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    low = np.concatenate([np.where((c >= 0x41) & (c <= 0x5A), c + 0x20, c), np.zeros(4, np.uint32)])
    mark, n = ((c >= 0x30) & (c <= 0x39)) | (c == 0x40), len(c)
    opened = (c == 0x28) | (c == 0x5B) | (c == 0x7B)
    mark |= opened & (low[1 : n + 1] == 0x61) & (low[2 : n + 2] == 0x74) & np.isin(low[3 : n + 3], (0x29, 0x5D, 0x7D))
    mark |= opened & (low[1 : n + 1] == 0x64) & (low[2 : n + 2] == 0x6F) & (low[3 : n + 3] == 0x74)
    marked = np.unique(np.searchsorted(start, np.flatnonzero(mark), "right") - 1)
    doc = np.searchsorted(first, start, "right") - 1
    is_open = np.zeros(len(start), bool)
    for r in range(-REACH, REACH + 1):
        at = marked + r
        ok = (at >= 0) & (at < len(start))
        ok[ok] &= doc[at[ok]] == doc[marked[ok]]
        is_open[at[ok]] = True
    at = np.flatnonzero(is_open)
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) != 0)) + 1
    out = []
    for run in np.split(at, cuts) if len(at) else ():
        d, base = int(doc[run[0]]), int(first[doc[run[0]]])
        out.append((d, list(zip((start[run] - base).tolist(), (end[run] - base).tolist(), strict=True))))
    return out


def _shape(word: str) -> str:
    return "".join("9" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isalpha() else c for c in word)


def features(word: str) -> list[int]:
    """Hashed features of a word ("" stands for the end of a chain); of a very long one its ends count."""
    digits = "".join(_DIGIT.findall(word[:400]))
    word = word if len(word) <= 64 else word[:40] + word[-24:]
    shape = _shape(word)
    short = re.sub(r"(.)\1+", r"\1", shape)
    names = ["-", f"s{shape[:24]}", f"c{short[:16]}", f"e{short[-6:]}", f"l{min(len(word), 20)}", f"d{min(len(digits), 20)}", "u" + "".join(sorted(set(re.sub("[aA9]", "", shape))))]
    if word.strip("()[]{}.,;:").isalpha() and len(word) <= 10:
        names.append(f"w{word.lower()}")
    if 13 <= len(digits) <= 19:
        names.append(f"n{luhn(digits)}")
    numbers = re.findall("[0-9]+", word)
    if len(numbers) == 4:
        names.append(f"o{all(_octets(p) for p in numbers)}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in names]


class Chains:
    """Chains of words laid end to end, longest first, with a number for each distinct word."""

    def __init__(self, words: list[list[str]]):
        self.order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        self.length = np.array([len(words[i]) for i in self.order], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        number: dict[str, int] = {"": 0}
        self.here = np.array([number.setdefault(w, len(number)) for i in self.order for w in words[i]], np.int64)
        self.before, self.after = np.roll(self.here, 1), np.roll(self.here, -1)
        self.before[self.begin] = 0
        self.after[self.begin + self.length - 1] = 0
        found = [features(w) for w in number]
        self.features, self.of = np.array([f for fs in found for f in fs]), np.repeat(np.arange(len(found)), [len(fs) for fs in found])
        self.starts = np.flatnonzero(np.diff(self.of, prepend=-1))

    def emissions(self, w: np.ndarray) -> np.ndarray:
        """(words, labels) from weights (3, WIDTH, labels), summed once per distinct word."""
        own = [np.add.reduceat(w[o][self.features], self.starts, axis=0) for o in range(3)]
        return own[0][self.here] + own[1][self.before] + own[2][self.after]

    def spread(self, g: np.ndarray) -> np.ndarray:
        """The gradient by the weights, from that by the emissions."""
        out, n = np.zeros((3, WIDTH, g.shape[1])), self.of[-1] + 1
        for o, at in enumerate((self.here, self.before, self.after)):
            for k in range(g.shape[1]):
                out[o, :, k] = np.bincount(self.features, np.bincount(at, g[:, k], n)[self.of], WIDTH)
        return out

    def steps(self) -> Iterator[np.ndarray]:
        """The words at place 1, 2, ... of all chains that have one."""
        for t in range(1, int(self.length.max(initial=0))):
            yield self.begin[: np.searchsorted(-self.length, -t, "left")] + t


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of steps and starts: I follows B or I of its kind only."""
    step = np.array([[_NEVER if b[0] == "I" and a[1:] != b[1:] else 0.0 for b in LABELS] for a in LABELS])
    return step, np.array([_NEVER if x[0] == "I" else 0.0 for x in LABELS])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(c: Chains, labels: np.ndarray, w: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels, and its gradients by the weights and by the moves between labels."""
    ban, first = _allowed()
    step, e = move + ban, c.emissions(w)
    a, b = e.copy(), np.zeros_like(e)
    a[c.begin] += first
    places = list(c.steps())
    for at in places:
        a[at] += _lse(a[at - 1][:, :, None] + step, 1)
    for at in reversed(places):
        b[at - 1] = _lse(step + (e[at] + b[at])[:, None, :], 2)
    last = c.begin + c.length - 1
    z = _lse(a[last], 1)
    zs = np.repeat(z, c.length)
    g, gm, total = -np.exp(a + b - zs[:, None]), np.zeros_like(move), float(first[labels[c.begin]].sum() - z.sum())
    for at in places:
        gm -= np.exp(a[at - 1][:, :, None] + step + (e[at] + b[at])[:, None, :] - z[: len(at), None, None]).sum(axis=0)
        np.add.at(gm, (labels[at - 1], labels[at]), 1)
        total += float(step[labels[at - 1], labels[at]].sum())
    n = np.arange(len(labels))
    g[n, labels] += 1
    return total + float(e[n, labels].sum()), c.spread(g), gm


def train(words: list[list[str]], labels: list[list[int]], rounds: int = 80, ridge: float = 0.02, rate: float = 0.15) -> dict:
    """Weights and moves by Adam steps on the penalised likelihood of all chains."""
    c = Chains(words)
    y = np.array([x for i in c.order for x in labels[i]], np.int64)
    p = [np.zeros((3, WIDTH, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, rounds + 1):
        _, *g = likelihood(c, y, *p)
        for i, (x, d) in enumerate(zip(p, g, strict=True)):
            d = d - ridge * x
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.99 * v[i] + 0.01 * d * d
            p[i] = x + rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-6)
    return {"w": p[0], "move": p[1]}


def viterbi(c: Chains, model: dict) -> list[np.ndarray]:
    """The best labels of each chain, in the order in which the chains came."""
    ban, first = _allowed()
    step, score = model["move"] + ban, c.emissions(model["w"])
    score[c.begin] += first
    back, best = np.zeros(score.shape, np.int8), np.zeros(len(score), np.int64)
    places = list(c.steps())
    for at in places:
        by = score[at - 1][:, :, None] + step
        back[at] = by.argmax(axis=1)
        score[at] += by.max(axis=1)
    last = c.begin + c.length - 1
    best[last] = score[last].argmax(axis=1)
    for at in reversed(places):
        best[at - 1] = back[at, best[at]]
    out: list = [None] * len(c.order)
    for i, b, n in zip(c.order, c.begin, c.length, strict=True):
        out[i] = best[b : b + n]
    return out


def _labelled(spans: list[tuple[str, int, int]], words: list[tuple[int, int]]) -> list[int]:
    """B and I of the first span that a word overlaps."""
    out, before = [], None
    for s, e in words:
        hit = next(((k, a, b) for k, a, b in spans if a < e and s < b), None)
        out.append(0 if hit is None else LABELS.index(f"{'I' if hit == before else 'B'}-{hit[0]}"))
        before = hit
    return out


def rewritten(kind: str, text: str) -> list[str]:
    """A base span's text in forms that the patterns do not know."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        name, _, domain = text.partition("@")
        return [name + a + domain.replace(".", d) for a, d in ((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" {at} ", "."), ("(at)", "(dot)"), (" @ ", "."), ("[at]", "."))]
    if kind == "ip":
        return [text.replace(".", x) for x in ("[.]", "(.)", " . ", "-")]
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [x.join(fours) for x in (".", "/", "_", "  ", " - ")]
    country, rest = digits[:-10], digits[-10:]
    a, b, c = rest[:3], rest[3:6], rest[6:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{country} {a} {b} {c}", f"+{country}/{a}/{b}/{c}", f"({a}){b} {c}"]


def _around(text: str, a: int, b: int) -> str:
    """A span with up to CONTEXT characters of whole words on either side."""
    low, high = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
    if low > 0:
        space = re.search(r"\s", text[low:a])
        low = low + space.end() if space else a
    if high < len(text):
        space = re.search(r"\s\S*$", text[b:high])
        high = b + space.start() if space else b
    return text[low:high]


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, passage, spans) around base spans, and around other numbers (kind "none")."""
    for batch in (b for whole in batches for b in blocks(whole, "text")):
        out = []
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            others = [m.span() for m in _CARD.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in spans)] if len(spans) < 1000 else []
            for kind, a, b in [*spans, *(("none", *s) for s in others[:20])]:
                if b - a > 200:
                    continue
                out.append((kind, _around(text, a, b)))
        yield pa.record_batch([pa.array([r[i] for r in out], pa.string()) for i in range(2)], names=["kind", "passage"])


def examples(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS, per_kind: int = PER_KIND) -> DataFrame:
    """The labelled table: (kind, passage) with at most `per_kind` distinct passages of each kind, from about `sample` documents."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    share = min(1.0, sample / max(1, texts.count()))
    texts = texts.where(F.pmod(F.xxhash64("text", F.lit(29)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    found = saved(texts.mapInArrow(_passages, "kind string, passage string").distinct())
    order = F.xxhash64("passage")
    picked = [found.where(F.col("kind") == k).orderBy(order, "passage").limit(per_kind) for k in (*KINDS, "none")]
    out = picked[0]
    for x in picked[1:]:
        out = out.unionByName(x)
    return out


def _training(kinds: list[str], passages: list[str]) -> tuple[list[list[str]], list[list[int]]]:
    """Chains and labels of the passages as they are and rewritten."""
    words, labels = [], []

    def add(text: str, spans: list) -> None:
        for _, run in chains([text]):
            words.append([text[s:e] for s, e in run])
            labels.append(_labelled(spans, run))

    for kind, text in sorted(zip(kinds, passages, strict=True)):
        spans = base_spans(text)
        add(text, spans)
        own = [x for x in spans if x[0] == kind]
        for k, a, b in own[:1]:
            forms = rewritten(k, text[a:b])
            for form in (forms[zlib.crc32(text.encode()) % len(forms)], forms[(zlib.crc32(text.encode()) // 7) % len(forms)]):
                added = text[:a] + form + text[b:]
                moved = len(form) - (b - a)
                rest = [(k2, s + moved * (s >= b), e + moved * (s >= b)) for k2, s, e in spans if (s, e) != (a, b) and (e <= a or s >= b)]
                add(added, [*rest, (k, a, a + len(form))])
    return words, labels


def _pack(model: dict) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, w=model["w"].astype(np.float32), move=model["move"])
    return out.getvalue()


def _unpack(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as f:
        return {"w": f["w"].astype(np.float64), "move": f["move"]}


def fit(labelled: DataFrame) -> dict | None:
    """The field from a labelled table (kind, passage) of bounded size, in one task; None where no passage has personal data."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        if not set(kinds) & set(KINDS):
            return pa.table({"model": pa.array([], pa.binary())})
        return pa.table({"model": pa.array([_pack(train(*_training(kinds, table["passage"].to_pylist())))], pa.binary())})

    found = labelled.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "model binary").collect()  # one model of a fixed size
    return _unpack(bytes(found[0]["model"])) if found else None


def added_spans(texts: list[str], model: dict | None, base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text that pass their check and overlap no base span."""
    out: list[list] = [[] for _ in texts]
    runs = chains(texts) if model else []
    if not runs:
        return out
    labels = viterbi(Chains([[texts[d][s:e] for s, e in run] for d, run in runs]), model)
    taken = [np.array(sorted((s, e) for _, s, e in b)).reshape(-1, 2) for b in base]
    reach = [np.maximum.accumulate(t[:, 1]) if len(t) else t[:, 1] for t in taken]
    for (d, run), y in zip(runs, labels, strict=True):
        at = 0
        while at < len(y):
            name, stop = LABELS[y[at]], at + 1
            if name[0] == "B":
                while stop < len(y) and LABELS[y[stop]] == f"I{name[1:]}":
                    stop += 1
                kind, s, e = name[2:], run[at][0], run[stop - 1][1]
                text = texts[d][s:e]
                lead = len(text) - len(re.sub(r"^[^0-9A-Za-z(+]+" if kind == "phone" else r"^[^0-9A-Za-z]+", "", text))
                s, e = s + lead, e - (len(text) - len(re.sub(r"[^0-9A-Za-z]+$", "", text)))
                k = np.searchsorted(taken[d][:, 0], e, "left")  # base spans that begin before e
                if s < e and (k == 0 or reach[d][k - 1] <= s) and _plausible(kind, texts[d][s:e]):
                    out[d].append((kind, s, e))
            at = stop
    return out


def find(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_<kind> (base spans), base_sha256, spans (base and added, "kind:start:end" by kind, then
    start), n_added.

    Null and empty texts have no spans. Null and repeated ids are rows like others; other columns are not read. Without a model
    there are base spans alone. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = ", ".join([f"id {kind}", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_added long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in blocks(whole, "text")):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, model, base)
            columns = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            whole_spans = [sorted([*b, *m], key=lambda s: (KINDS.index(s[0]), s[1])) for b, m in zip(base, more, strict=True)]
            columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(s) for s in whole_spans]), pa.array([len(m) for m in more], pa.int64())]
            yield pa.record_batch([batch.column("id"), *columns], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, shape).withColumnRenamed("id", id_col)
