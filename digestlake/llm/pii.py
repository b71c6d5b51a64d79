"""Personal data by candidate generation and boosted trees.

Base rules find e-mail addresses, IP addresses, card and phone numbers; what they find always stays. Generators with
high recall propose further spans, which may overlap: addresses with "at" and "dot" spelled out or in brackets, IP
addresses in brackets, cards and phones in looser formats, any number long enough, and long runs of letters and digits
that may be secrets (keys, tokens). Boosted trees score each proposal by its format and its context, the score is
calibrated, and each kind has the threshold at which held-out proposals reach the wanted precision. Of proposals above
it that overlap, the best stays; base spans come before all.

There are no labels for personal data in the tables. The trees are trained on sentences made by rule from a seed
(TRAIN_ROWS of them), formats filled at random in contexts that name them against what only looks alike, and on weak
labels from at most WEAK_DOCS documents: what the base rules find there against numbers of the same look that fail them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.llm.boosting import Boosted
from digestlake.llm.common import prepared, quoted, slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans, in the order in which they are told; the base rules know only the first ones.
EVERY = (*KINDS, "secret")
#: Sentences that the trees are fitted on, and those that calibrate them.
TRAIN_ROWS = 4000
#: Documents, chosen by a hash of doc_id, that weak labels come from, and candidates of each, at most.
WEAK_DOCS, WEAK_SPANS = 4000, 20
PRECISION = 0.95
CONTEXT = 40
Span = tuple[int, int]

# The patterns of the contract. A lookbehind keeps a search from starting again inside a run of digits, which finds the
# same leftmost matches in linear time; addresses are found from their @ for the same reason.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
# Proposals. Every part is bounded, so a search stays linear.
_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
_OBFUSCATED_HINT = re.compile(r"\(at\)|\[at\]|@ | @| at [A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot )", re.I)
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\[\.\]|\(\.\)| ?\[dot\] ?)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.| ?\[dot\] ?)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.| ?\[dot\] ?)[0-9]{1,3}(?![0-9])")
_LOOSE_NUMBER = re.compile(r"(?<![0-9])(?:\(?[0-9]{1,6}\)?[ ./-]{0,2}){2,8}(?<=[0-9])(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+=*+(?![A-Za-z0-9+/_=-])")
#: Words near personal data, by kind, in the languages of the corpus.
CUES = {
    "email": "mail email e-mail courriel correo contact kontakt contacto write escriba address adresse",
    "ip": "ip host server address adresse dirección login client",
    "card": "card visa mastercard amex carte tarjeta karte credit kredit payment paid cvv",
    "phone": "phone tel telephone call mobile cell fax téléphone teléfono telefon handy llame appelez ring",
    "secret": "token secret key apikey api_key password passwd pwd auth bearer credential access_key private",
}
_CUE = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v.split())) + r")(?!\w)", re.I) for k, v in CUES.items()}
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
#: Words before runs that look like secrets and are none.
_LOOKS = re.compile(r"(?:commit|sha1|sha256|md5|etag|checksum|digest|hash|uuid|revision|file|path|image)\W*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the base rules, by kind, in order."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGITS.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Candidate spans of the generators; they may overlap."""
    out = []
    if _OBFUSCATED_HINT.search(text):
        out += [("email", *m.span()) for m in _OBFUSCATED.finditer(text)]
    if _DIGITS.search(text):
        if "[" in text or "(" in text:
            out += [("ip", *m.span()) for m in _LOOSE_IP.finditer(text)]
        for m in _LOOSE_NUMBER.finditer(text):
            a, b = m.span()
            n = sum("0" <= c <= "9" for c in m.group())
            if m.group().startswith("(") and ")" not in m.group():
                a += 1
            if 7 <= n <= 15:
                out.append(("phone", a, b))
            if 13 <= n <= 19:
                out.append(("card", a, b))
    for m in _SECRET.finditer(text):
        kinds = {"d" if "0" <= c <= "9" else "a" for c in m.group() if c.isalnum()}
        if len(kinds) == 2:
            out.append(("secret", *m.span()))
    return out


def _entropy(span: str) -> float:
    _, n = np.unique(np.frombuffer(span.encode(), dtype=np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    span, left, right = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = [c for c in span if "0" <= c <= "9"]
    groups = re.findall(r"[0-9]+", span)
    before, after = (left or " ")[-1], (right or " ")[0]
    return [
        *(float(kind == k) for k in EVERY),
        float(len(span)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(set(digits))), float(luhn("".join(digits)) if digits else 0), float(groups[:1] != [] and groups[0][0] in "3456"),
        float("(" in span), float("-" in span), float("." in span), float("/" in span), float(" " in span), float("@" in span), float("dot" in span.lower() or "[" in span),
        float(sum(c.isalpha() for c in span)), float(before.isalnum()), float(after.isalnum()), float(before in "$€£#+-./"), float(after in "%$€£+-/:"),
        float(bool(groups) and len(groups) == 3 and [len(g) for g in groups] == [3, 3, 4]), float(len(groups) == 4 and all(len(g) == 4 for g in groups)),
        _entropy(span), float(bool(_HEX.fullmatch(span))), len(digits) / len(span), float(len(re.findall(r"[_/-]", span))), float(bool(_ASSIGNED.search(left))), float(before in "\"'"), float(bool(_LOOKS.search(left))),
        *(float(bool(_CUE[k].search(left))) for k in EVERY), float(bool(_CUE[kind].search(left) or _CUE[kind].search(right))),
    ]


def _sentences(seed: int, n: int) -> Iterator[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of made-up sentences with one candidate each."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    word = lambda: "".join("abcdefghijklmnoprstuvw"[i] for i in rng.integers(0, 22, rng.integers(2, 9)))
    pick = lambda *xs: xs[int(rng.integers(0, len(xs)))]

    def card() -> str:
        body = pick("4", "5", "37", "6") + num(14)
        body = body[: pick(15, 15, 14, 12)]
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def grouped(digits: str) -> str:
        sep = pick(" ", ".", "/", "-")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def phone() -> str:
        a, b, c = str(rng.integers(2, 10)) + num(2), num(3), num(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{num(2)} {a} {b} {c}", f"0{a}/{b}{c}", f"0{num(3)} {num(3)} {num(3)}")

    def email() -> str:
        a, b, c = word(), word(), pick("com", "org", "net", "example.com")
        return pick(f"{a} at {b} dot {c}", f"{a}(at){b}.{c}", f"{a} [at] {b} [dot] {c}", f"{a}@ {b}.{c}", f"{a} @ {b}.{c}")

    def ip() -> str:
        p = [str(x) for x in rng.integers(0, 256, 4)]
        return pick("[.]".join(p), f"{p[0]}[.]{p[1]}.{p[2]}.{p[3]}", "(.)".join(p), " [dot] ".join(p))

    def other(kind: str) -> str:
        if kind == "email":
            return pick(f"{word()} at {word()} dot {word()}", f"{word()} @ {num(2)}.{num(2)}")
        if kind == "ip":
            return "[.]".join(str(x) for x in rng.integers(256, 999, 4))
        if kind == "secret":
            return plain()
        if kind == "card":
            return pick(num(int(rng.integers(13, 20))), " ".join(num(4) for _ in range(4)), grouped(num(16)))
        return pick(num(int(rng.integers(7, 16))), f"{rng.integers(1900, 2100)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{rng.integers(1900, 2100)}", f"{num(3)} {num(3)} {num(3)}", f"{num(4)} {num(4)}", f"{num(1)}.{num(3)}.{num(3)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(3)}-{num(4)}", f"{num(5)}-{num(4)}")

    chars = {"hex": "0123456789abcdef", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
    some = lambda of, k: "".join(chars[of][i] for i in rng.integers(0, len(chars[of]), k))

    def secret() -> str:
        value = pick(some("hex", 32), some("hex", 40), some("hex", 40).upper(), some("hex", 64), some("mixed", int(rng.integers(20, 48))), "sk_live_" + some("mixed", 24), "AKIA" + some("mixed", 16).upper(), "ghp_" + some("mixed", 36))
        return value if any(c.isdigit() for c in value) else value + "7"

    def plain() -> str:
        return pick(f"{word()}_{word()}_{word()}{word()}_{num(1)}", f"{word()}-{word()}{word()}-{num(4)}-{num(2)}-{word()}", f"{word()}/{word()}{word()}/{word()}{num(3)}", some("hex", 40), some("hex", 32), f"{some('hex', 8)}-{some('hex', 4)}-{some('hex', 4)}-{some('hex', 12)}") + pick("", "a1b2c3d4")

    made = {"secret": secret, "email": email, "ip": ip, "card": lambda: grouped(card()), "phone": phone}
    for _ in range(n):
        kind = EVERY[int(rng.integers(0, len(EVERY)))]
        good = rng.random() < 0.4
        cue = pick(*CUES[kind].split())
        value = made[kind]() if good else other(kind)
        lead = [word() for _ in range(int(rng.integers(1, 6)))]
        if kind == "secret":  # named and assigned, against hashes, names and paths
            value = value if len(value) >= 16 else value + "0" * 16
            lead += [pick(cue, cue.upper()) if good else pick("commit", "sha256", "etag", "file", "uuid", word(), word())]
            start = " ".join(lead) + pick(" = ", "=", ": ", ":") * (good or rng.random() < 0.3)
            quote = pick('"', "'", "")
            start += quote if start[-1] in " =:" else " "
            closed = quote if start.endswith(quote) else ""
            yield start + value + closed + pick(" ", ", ", ". ") + word(), kind, len(start), len(start) + len(value), int(good)
            continue
        # a number that looks right is personal where a cue names it; spelled-out addresses are personal by format
        if good and (kind in ("card", "phone") or rng.random() < 0.5):
            lead += [cue, pick("", ":", "is", "no.")]
        elif not good and rng.random() < 0.2:
            lead += [pick("order", "id", "ref", "page", "year", "date", "version", "total")]
        start = " ".join(x for x in lead if x) + " "
        yield start + value + pick(" ", ", ", ". ") + word(), kind, len(start), len(start) + len(value), int(good)


#: Features, labels, kinds, and whether the base rules leave the row to the trees.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _fitted(train: Rows, held: Rows, precision: float) -> tuple[Boosted, dict[str, float]]:
    """Trees on train, calibrated on held, and each kind's threshold: the least score at which the held rows of the kind
    that the base rules do not find reach the precision. A kind that never does is never accepted."""
    model = Boosted().fit(train[0], train[1])
    model.calibrate(held[0], held[1])
    p, limits = model.predict(held[0]), {}
    for k in EVERY:
        own = (held[2] == k) & held[3]
        order = np.argsort(-p[own], kind="stable")
        ps, ys = p[own][order], held[1][own][order]
        # rows that score alike are accepted together, so only the last of them counts
        last = np.append(ps[1:] != ps[:-1], True)[: len(ps)]
        ok = np.nonzero((np.cumsum(ys) / np.arange(1, len(ys) + 1) >= precision) & last)[0]
        limits[k] = float(ps[ok[-1]]) if len(ok) and ys.any() else 1.1
    return model, limits


def _made(seed: int, rows: int) -> Rows:
    got = list(_sentences(seed, rows))
    left = [not _overlaps(sorted(s for spans in base_spans(t).values() for s in spans), a, b) for t, _, a, b, _ in got]
    return np.array([features(t, k, a, b) for t, k, a, b, _ in got]), np.array([g[4] for g in got]), np.array([g[1] for g in got]), np.array(left)


@lru_cache(maxsize=2)
def trained(seed: int = 7, rows: int = TRAIN_ROWS, precision: float = PRECISION) -> tuple[Boosted, dict[str, float]]:
    """The trees and thresholds from made-up sentences alone."""
    return _fitted(_made(seed, rows), _made(seed + 1, rows), precision)


def weak_labels(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, label): what the base rules find, and proposals of the same look that fail them."""
    base = base_spans(text)
    out = [(k, a, b, 1) for k in KINDS for a, b in base[k]]
    taken = sorted(s for spans in base.values() for s in spans)
    for k, a, b in proposals(text):
        digits = "".join(c for c in text[a:b] if "0" <= c <= "9")
        inside = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
        if not _overlaps(taken, a, b) and ((k == "card" and not luhn(digits)) or (k == "phone" and inside)):
            out.append((k, a, b, 0))
    return out[:WEAK_SPANS]


def _weak(docs: DataFrame, most: int) -> Rows:
    """Weak labels of a sample of docs (doc_id, text), as features, labels and kinds."""
    n = docs.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    sample = docs.where(F.col("doc_id").isNotNull() & (place < int(min(1.0, most / max(1, n)) * (1 << 31)))).select("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, many in slices(b.column(0)):
                rows = [(k, float(y), features(t, k, s, e)) for t in b.column(0).slice(at, many).to_pylist() if t for k, s, e, y in weak_labels(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["kind", "label", "x"])

    # most documents times WEAK_SPANS candidates; sorted, so that the trees do not depend on the order of arrival
    got = sorted((r.kind, r.label, tuple(r.x)) for r in sample.mapInArrow(scan, "kind string, label double, x array<double>").collect())
    width = len(features("a 1", "card", 2, 3))
    return np.array([r[2] for r in got]).reshape(len(got), width), np.array([int(r[1]) for r in got], dtype=int), np.array([r[0] for r in got], dtype=object), np.array([r[1] == 0 for r in got], dtype=bool)


def learned(docs: DataFrame, seed: int = 7, rows: int = TRAIN_ROWS, precision: float = PRECISION, weak_docs: int = WEAK_DOCS) -> tuple[Boosted, dict[str, float]]:
    """The trees and thresholds from made-up sentences and the weak labels of docs (doc_id, text): every second weak
    row trains, the others calibrate and set thresholds."""
    weak = _weak(docs, weak_docs)
    halves = [tuple(np.concatenate([m, w[part::2]]) for m, w in zip(_made(seed + part, rows), weak)) for part in (0, 1)]
    return _fitted(*halves, precision)


def added_spans(text: str, base: dict[str, list[Span]], model: Boosted, limits: dict[str, float]) -> dict[str, list[Span]]:
    """Proposals that the trees accept, none of which overlaps a base span or a better proposal."""
    taken = sorted(s for spans in base.values() for s in spans)
    some = [c for c in proposals(text) if not _overlaps(taken, c[1], c[2])]
    out: dict[str, list[Span]] = {k: [] for k in EVERY}
    if not some:
        return out
    p = model.predict(np.array([features(text, *c) for c in some]))
    good = sorted((-float(q), a, b, k) for q, (k, a, b) in zip(p, some) if q >= limits[k])
    chosen: list[Span] = []
    for _, a, b, k in good:
        if not _overlaps(chosen, a, b):
            from bisect import insort

            insort(chosen, (a, b))
            out[k].append((a, b))
    return {k: sorted(v) for k, v in out.items()}


def _overlaps(spans: list[Span], a: int, b: int) -> bool:
    """spans: sorted; they may overlap each other, but each is short."""
    from bisect import bisect_left

    i = bisect_left(spans, (b, -1))
    # base spans of two kinds may overlap, so look back a few
    return any(spans[j][1] > a for j in range(max(0, i - 4), i))


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in EVERY for a, b in spans.get(k, ()))


def find_pii(docs: DataFrame, text_col: str = "text", seed: int = 7, train_rows: int = TRAIN_ROWS, precision: float = PRECISION, weak_docs: int = WEAK_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, redacted.

    base_spans are what the base rules find, spans those and the accepted proposals, as kind:start:end in code points,
    end exclusive, ordered by kind and start; the kind secret comes last. The counts are of base spans. redacted is the
    text with each span replaced by its kind in angle brackets; where spans overlap, the union gets the kind of the
    first. Of accepted proposals that overlap and score alike, the one that begins first stays, then the shorter, then
    the first kind in alphabetical order. Null text counts as empty. Repeated rows give repeated rows; an empty table
    gives an empty result; other columns are not read.
    """
    prepared(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    model, limits = learned(rows, seed, train_rows, precision, weak_docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "redacted"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, many in slices(b.column(1)):
                cols: list[list] = [[] for _ in names]
                for doc_id, text in zip(b.column(0).slice(at, many).to_pylist(), b.column(1).slice(at, many).to_pylist()):
                    text = text or ""
                    base = base_spans(text)
                    more = added_spans(text, base, model, limits)
                    every = {k: sorted(base.get(k, []) + more[k]) for k in EVERY}
                    for c, v in zip(cols, [doc_id, *(len(base[k]) for k in KINDS), joined(base), joined(every), redact(text, every)]):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.string()] * 3)], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string, redacted string"
    return rows.mapInArrow(scan, schema)


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    out, last = [], 0
    for a, b, k in sorted((a, b, k) for k in EVERY for a, b in spans.get(k, ())):
        if a >= last:
            out += [text[last:a], f"<{k}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def span_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))
