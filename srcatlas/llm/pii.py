"""Personal data: strict patterns, and candidates that boosted trees select by format and context."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.boost import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # a run without dots too: else each of its digits would begin a search
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum ends in 0."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of the strict patterns, those that fail their test dropped.

    Each scan is linear in the text, also on endless runs of one class: an address is
    found from its @ backwards, and a dotted number as one run cut into fours.
    """
    out: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    at, end = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        found = _DOMAIN.match(text, at + 1) if lo < at else None
        if found:
            end = found.end()
            out["email"].append((lo, end))
        else:
            end = max(end, lo) if lo < at else end
        at = text.find("@", max(at + 1, end))
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        lo = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            hi = lo + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out["ip"].append((lo, hi))
            lo = hi + 1
    for run in _SPACED.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "") if run.end() - run.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(run.span())
    if "+" in text:
        for run in _PLUS.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", run.group())) <= 15:
                out["phone"].append(run.span())
    return out


_RUN = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){5,}")
_VEILED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}[ ]{0,2}(?:@|\(at\)|\[at\]|\{at\}|(?<= )at(?= ))[ ]{0,2}[A-Za-z0-9-]{1,63}(?:[ ]{0,2}(?:\.|\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= ))[ ]{0,2}[A-Za-z0-9-]{1,63}){1,5}", re.I
)
_VEIL = re.compile(r"[(\[{](?:at|dot)[)\]}]| dot ", re.I)
_DIGIT = re.compile(r"[0-9]")
_TAIL = re.compile(r"[A-Za-z]*$")
_GROUPS = re.compile(r"[0-9]+")
_BEFORE, _AFTER = re.compile(r"([0-9]+)([ ().\-/+]{0,3})$"), re.compile(r"([ ().\-/+]{0,3})([0-9]+)")
_FOR = {"email": re.compile(r"mail|contact|write|reach", re.I), "ip": re.compile(r"\bip\b|host|server|addr|from", re.I), "card": re.compile(r"card|visa|amex|master|credit|pay", re.I), "phone": re.compile(r"phone|tel|call|fax|mobile|cell|whatsapp|dial|sms", re.I)}
_AGAINST = re.compile(r"order|invoice|version|isbn|\bid\b|date|page|\bno\b|ref|sku|serial|score|ticket|tracking|build|section|figure|year", re.I)


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Overlapping spans that might be personal data, with the kind each might be: high recall, low precision.

    Of a run of digits, however long, all consecutive groups of 7 to 19 digits are
    proposed, so that each number of a list or table row is; that is linear in the run.
    """
    if _VEIL.search(text):
        yield from (("email", *m.span()) for m in _VEILED.finditer(text))
    for run in _RUN.finditer(text):
        groups = [m.span() for m in _GROUPS.finditer(text, *run.span())]
        for i, (a, _) in enumerate(groups):
            while a > run.start() and text[a - 1] in "+(":
                a -= 1
            n = 0
            for j in range(i, len(groups)):
                lo, b = groups[j]
                n += b - lo
                if n > 19:
                    break  # longer than any number of these kinds
                if 7 <= n <= 15:
                    yield "phone", a, b
                if 12 <= n <= 19:
                    yield "card", a, b
                if 4 <= n <= 12 and text.count(".", a, b) == 3:
                    yield "ip", a, b


def features(text: str, kind: str, lo: int, hi: int) -> list[float]:
    """Format and context of one candidate."""
    s, left = text[lo:hi], text[max(0, lo - 24) : lo]
    groups = _GROUPS.findall(s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    before, after = text[lo - 1 : lo] if lo else "", text[hi : hi + 1]
    return [
        *(float(kind == k) for k in KINDS),
        len(digits),
        len(groups),
        s.startswith("+"),
        "(" in s and ")" in s,
        s.count("-"),
        s.count("."),
        s.count(" "),
        s.count("/"),
        12 <= len(digits) <= 19 and luhn(digits),
        len(groups) == 4 and all(z <= 3 and int(g) <= 255 for z, g in zip(sizes, groups, strict=True)),
        max(sizes),
        min(sizes),
        sizes[0],
        sizes[-1],
        float(bool(_FOR[kind].search(left))),
        float(bool(_AGAINST.search(left))),
        float(before.isalnum() or before in "#$.,:-_/=" and before != ""),
        float(after.isalnum() or after in "%-_/=" and after != ""),
        float(bool(re.match(r"\(?(?:19|20)[0-9]{2}\b", s))),
        float(digits[:1] or 0),
        float(bool(_VEIL.search(s))),
        len(digits) / max(1, len(s)),
        len(set(digits)),
        len(_TAIL.search(s).group()),
        *_beside(text, lo, hi),
    ]


def _beside(text: str, lo: int, hi: int) -> list[float]:
    """Of the digits next to a span on either side: how many, and whether what lies between is other than a space or slash."""
    left, right = _BEFORE.search(text[max(0, lo - 24) : lo]), _AFTER.match(text[hi : hi + 24])
    out = []
    for digits, gap in ((left.group(1), left.group(2)) if left else ("", " "), (right.group(2), right.group(1)) if right else ("", " ")):
        out += [float(len(digits)), float(gap.strip(" /") != "" or gap == "")]
    return out


def _examples(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of generated numbers and addresses in generated contexts."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def number(valid: bool) -> str:
        body = r.choice("3456") + d(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        return body + (last if valid else r.choice([c for c in "0123456789" if c != last]))

    def fours(x: str) -> str:
        return r.choice([" ", "-"]).join(x[i : i + 4] for i in range(0, 16, 4))

    good = {
        "email": lambda: f"{word()}{r.choice(['', '', '.' + word(), '_' + d(2), d(2)])}{r.choice([' (at) ', ' [at] ', '(at)', '[at]', ' at '])}{word()}{r.choice([' (dot) ', ' [dot] ', '[dot]', ' dot '])}{r.choice(['com', 'org', 'net', 'de'])}",
        "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "card": lambda: (lambda x: r.choice([x, fours(x)]))(number(True)),
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(4)} {d(3)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"00{r.randint(1, 99)} {d(3)} {d(7)}", f"0{d(3)} {d(7)}"]),
    }
    bad = {
        "email": lambda: f"{word()} at {word()} dot {word()}{word()}{word()}",
        "ip": lambda: r.choice([f"{r.randint(256, 999)}.{d(2)}.{d(2)}.{d(3)}", f"{d(4)}.{d(2)}.{d(3)}.{d(2)}"]),
        "card": lambda: r.choice([(lambda x: r.choice([x, fours(x)]))(number(False)), d(13), d(15) + "0", d(19)]),
        "phone": lambda: r.choice(["{}-{:02d}-{:02d}".format(r.randint(1900, 2090), r.randint(1, 12), r.randint(1, 28)), d(8), d(10), d(12), d(14), number(False), number(True), f"{d(3)}.{d(2)}.{d(2)}.{d(2)}", f"{d(4)} {d(4)} {d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(1)}.{d(6)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(4)}-{d(4)}", " ".join(d(r.randint(1, 2)) for _ in range(r.randint(5, 12)))]),
    }
    cues = {"email": ["email", "contact", "mail me:"], "ip": ["ip", "host", "server"], "card": ["card", "visa", "pay with"], "phone": ["phone", "tel.", "call", "fax"]}
    noise = ["order", "invoice", "version", "isbn", "id", "date", "page", "no", "ref", "sku", "ticket"]
    out = []
    for i in range(n):
        kind, label = KINDS[i % 4], (i // 4) % 2
        body = (good if label else bad)[kind]()
        lead = r.choice(cues[kind]) if r.random() < (0.6 if label else 0.1) else r.choice(noise) if r.random() < (0.03 if label else 0.5) else word()
        head = f"{word()} {word()} {lead} "
        tail = r.choice([" ", ". ", ", "]) + word()
        if not label and r.random() < 0.15:
            head = head.rstrip() + r.choice("#$-_")
        out.append((head + body + tail, kind, len(head), len(head) + len(body), label))
    for _ in range(n // 6):  # numbers side by side, as in lists and rows: right are those, wrong all other groups of digits
        kind = r.choice(["phone", "phone", "card"])
        style = r.randrange(10**9)
        text, right = f"{word()} {r.choice([*cues[kind], word(), word()])}{r.choice(['', ':', '.'])} ", set()
        for k in range(r.randint(1, 4)):
            # mostly of one kind and style, as in lists; else as it comes, as in records
            own = kind if r.random() < 0.6 else r.choice(["phone", "ip", "card"])
            if own == "card":
                x = number(True)
                body = x if style % 3 == 0 else fours(x)
            elif own == "ip":
                body = good["ip"]()
            else:
                body = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(4)} {d(3)}"][style % 6]
            right.add((own, len(text), len(text) + len(body)))
            text += body + r.choice([" ", " ", " / ", "  ", ", "])
        text += r.choice([f"{d(2)}/{d(2)}", d(3)]) if kind == "card" and r.random() < 0.5 else word()
        found = list(candidates(text))
        wrong = [c for c in found if c not in right]
        out += [(text, *c, 1) for c in found if c in right] + [(text, *c, 0) for c in r.sample(wrong, min(len(wrong), 6))]
    return out


def calibrated(score: np.ndarray, label: np.ndarray, precision: float, prior: float) -> float:
    """The threshold at which held-out scores promise ``precision``, if a share ``prior`` of all candidates is right.

    False alarms are counted with half of one to spare, so that few examples promise
    little. Of the thresholds that reach the precision the lowest is taken, halfway (in
    log-odds) down to the next score below; where none does, the one that comes nearest.
    """
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    hit, wrong = np.cumsum(y) / max(1, y.sum()), (np.cumsum(1 - y) + 0.5) / (len(y) - y.sum() + 1)
    promised = prior * hit / (prior * hit + (1 - prior) * wrong)
    ends = np.concatenate([s[1:] != s[:-1], [True]])  # equal scores go together
    good = np.nonzero(ends & (promised >= precision))[0]
    at = int(good[-1]) if len(good) else int(np.where(ends, promised, -1).argmax())
    logit = lambda p: float(np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9))))
    below = logit(s[at + 1]) if at + 1 < len(s) else logit(s[at])
    return float(1 / (1 + np.exp(-(logit(s[at]) + below) / 2)))


@lru_cache(maxsize=1)
def model(examples: int = 12_000, precision: float = 0.95, prior: float = 0.1, seed: int = 7) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and each kind's threshold (see calibrated).

    They are trained here, on ``examples`` generated examples, of which every third is
    held out to calibrate. The same call gives the same model on every machine.
    """
    rows = _examples(examples, seed)
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows], dtype=float)
    y = np.array([label for *_, label in rows], dtype=float)
    kinds = np.array([k for _, k, *_ in rows])
    held = np.arange(len(rows)) // 8 % 3 == 0
    trees = BoostedTrees().fit(x[~held], y[~held])
    score = trees.predict(x)
    return trees, {kind: calibrated(score[held & (kinds == kind)], y[held & (kinds == kind)], precision, prior) for kind in KINDS}


class _Taken:
    """Disjoint spans in order, to look up whether another one overlaps any."""

    def __init__(self, spans: list[Span]):
        self.lo: list[int] = []
        self.hi: list[int] = []
        for lo, hi in sorted(spans):
            if self.hi and lo < self.hi[-1]:
                self.hi[-1] = max(self.hi[-1], hi)
            else:
                self.lo.append(lo)
                self.hi.append(hi)

    def free(self, lo: int, hi: int) -> bool:
        i = bisect_left(self.lo, hi)
        return i == 0 or self.hi[i - 1] <= lo

    def add(self, lo: int, hi: int) -> None:
        i = bisect_left(self.lo, lo)
        self.lo.insert(i, lo)
        self.hi.insert(i, hi)


#: So many candidates are scored together.
SCORED = 20_000


def all_spans(texts: list[str], trees: BoostedTrees, limits: dict[str, float]) -> list[tuple[dict, dict]]:
    """For each text the base spans and the spans the trees add, which overlap no other of their text.

    Of overlapping candidates above their kind's threshold the one of the best score
    stays, of equals the first. Candidates are scored in parts, and only those above the
    threshold are held.
    """
    bases, taken = [], []
    fit: list[tuple[float, tuple[int, str, int, int]]] = []
    asked: list[tuple[int, str, int, int]] = []

    def decide() -> None:
        if asked:
            score = trees.predict(np.array([features(texts[i], kind, lo, hi) for i, kind, lo, hi in asked], dtype=float))
            fit.extend((-p, c) for p, c in zip(score.tolist(), asked, strict=True) if p >= limits[c[1]])
            asked.clear()

    for i, text in enumerate(texts):
        bare = _DIGIT.search(text) is None and "@" not in text and _VEIL.search(text) is None
        base = {kind: [] for kind in KINDS} if bare else base_spans(text)
        bases.append(base)
        taken.append(_Taken([s for spans in base.values() for s in spans]))
        for kind, lo, hi in () if bare else candidates(text):
            if taken[i].free(lo, hi):
                asked.append((i, kind, lo, hi))
                if len(asked) == SCORED:
                    decide()
    decide()
    added: list[dict] = [{kind: [] for kind in KINDS} for _ in texts]
    for _, (i, kind, lo, hi) in sorted(fit):
        if taken[i].free(lo, hi):
            taken[i].add(lo, hi)
            added[i][kind].append((lo, hi))
    return list(zip(bases, added, strict=True))


SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
#: So many texts are scored together.
GROUP = 256


def find(docs: DataFrame, text: str = "text", name: str = "pii", **options) -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, base), in order of kind, then start.

    Offsets count code points, ends are exclusive. Spans of the strict patterns are all
    there (base is true); candidates that the trees score above their kind's threshold
    are added where they overlap no other. Null and empty texts have no spans. The
    model is a few KB and independent of the documents; each row is judged alone.
    """
    trees, limits = model(**options)

    @F.arrow_udf(SPANS)
    def udf(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), GROUP):
            part = [(t.as_py() or b"").decode("utf-8", "replace") for t in texts[at : at + GROUP]]
            for base, added in all_spans(part, trees, limits):
                out.append([{"kind": k, "start": a, "end": b, "base": own} for k in KINDS for a, b, own in sorted([(*s, True) for s in base[k]] + [(*s, False) for s in added[k]])])
        return pa.array(out, _SPAN_TYPE)

    return docs.withColumn(name, udf(F.col(text).cast("binary")))


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind, as in [EMAIL]; other rows and columns unchanged.

    Spans that overlap are replaced together, under the kind of the first.
    """
    found = find(docs, text, "__pii", **options)
    merged = F.expr(
        "aggregate(array_sort(transform(__pii, s -> named_struct('lo', s.start, 'hi', s.end, 'kind', upper(s.kind)))), "
        "cast(array() as array<struct<lo: bigint, hi: bigint, kind: string>>), (done, s) -> case "
        "when size(done) > 0 and s.lo < element_at(done, -1).hi then concat(slice(done, 1, size(done) - 1), array(named_struct('lo', element_at(done, -1).lo, 'hi', greatest(element_at(done, -1).hi, s.hi), 'kind', element_at(done, -1).kind))) "
        "else concat(done, array(s)) end)"
    )
    pieces = F.expr(
        f"concat(array_join(transform(__spans, (s, i) -> concat(substr(`{text}`, if(i = 0, 0, __spans[i - 1].hi) + 1, s.lo - if(i = 0, 0, __spans[i - 1].hi)), '[', s.kind, ']')), ''), "
        f"substr(`{text}`, element_at(__spans, -1).hi + 1))"
    )
    return found.withColumn("__spans", merged).withColumn(text, F.when(F.size("__spans") > 0, pieces).otherwise(F.col(text))).select(*docs.columns)
