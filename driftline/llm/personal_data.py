"""Personal data by weak-supervision aggregation.

Candidate spans of four kinds (email, ip, card, phone) come from strict shapes
(:func:`base_spans`, the contract's own rules) and from loose ones: spelled-out
addresses (``a [at] b [dot] c``), defanged and version 6 addresses, card numbers
with other separators, phone numbers without a plus. Six labelers vote yes, no
or nothing on each candidate: shape (regex), arithmetic (check digits, ranges),
gazetteer (top-level domains, issuer prefixes, calling codes, reserved blocks),
context (words before the span), edges (what the span is glued to) and company
(another candidate close by).

Expectation-maximisation estimates, for each kind, how often a labeler gives
each vote on true and on false spans. A strict match that passes its check is
known to be true, a candidate that fails its check known to be false; the
labels of all others are latent. The estimated probabilities then train the
final span classifier, a logistic model over the votes and the outer form of
the span. Base spans always stay; a loose span is added if the classifier gives
it one half or more and it overlaps no span before it.

Scale. Two passes over the texts, each a map without a shuffle of texts. The
first sends vote patterns with their counts, summed by a partial aggregate: at
most ``3 ** 6`` votes times kinds, anchors and forms (:data:`MAX_PATTERNS`,
whatever the corpus), which is all that the driver reads. Every text is scanned
whole and in linear time: scans start at ``@``, ``+``, brackets and digits and
never look at a character more than a fixed number of times.

Defined results: null and empty texts have no spans; texts of any length; rows
that repeat a whole row get the same result, one row each; a null id stays
null; equal starts are ordered by end; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
FORMS = 8              # outer forms of a span, at most
LABELERS = 6
#: vote patterns that can exist: kinds x anchors x forms x votes
MAX_PATTERNS = len(KINDS) * 3 * FORMS * 3 ** LABELERS

# fixed values: the strict shapes
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+")

NUMBERS = re.compile(r"[0-9][0-9 .()/_\u00a0-]{5,}")
AT = re.compile(r" ?(?:\[ ?at ?\]|\( ?at ?\)|\{ ?at ?\}) ?| at ", re.IGNORECASE)
SPELLED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?(?:\[ ?dot ?\]|\( ?dot ?\)|\{ ?dot ?\}) ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
DOT_WORD = re.compile(r"[\[({]? ?\bdot\b ?[\])}]?", re.IGNORECASE)
DEFANGED = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}")
SIX = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
LOOSE_CARD = re.compile(r"[0-9]{4}([./_\u00a0])[0-9]{4}\1[0-9]{4}\1[0-9]{4}")
LOOSE_PHONE = re.compile(r"(?:00[1-9][0-9 .-]{7,16}[0-9])|(?:[0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
#: marks of a spelled-out or defanged address: texts without any are not scanned for them
SPELLED_MARKS = ("[at]", "(at)", "{at}", "[AT]", "(AT)", "{AT}", "[ at", "( at", "{ at", " dot ", " DOT ")

# gazetteers
DOMAINS = frozenset(
    "com org net edu gov mil int info biz io co me tv app dev ai eu uk de fr es it nl be ch at se no dk fi pl cz pt gr ie ru ua "
    "tr il us ca mx br ar cl au nz jp cn kr in sg hk tw za ng ke eg".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[689]|35|6011|64[4-9]|65|62|50|5[6-9]|6[0-9]")
CALLING = re.compile(
    r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21\d|22\d|23\d|24\d|25\d|26\d|29\d|35\d|37\d|38\d|42\d|50\d|59\d|"
    r"67\d|68\d|69\d|80\d|85\d|87\d|88\d|96\d|97\d|99\d")
CUES = {
    "email": "e-?mails?|mail|contact|write|reach|address|from|cc|correo|courriel|kontakt",
    "ip": "ip|ipv4|ipv6|host|server|address|client|login|logged|addr|adresse|servidor",
    "card": "cards?|visa|mastercard|amex|credit|debit|payment|pay|tarjeta|carte|karte|cvv|expir\\w*",
    "phone": "phones?|call|tel|mobile|cell|fax|dial|sms|contact|whatsapp|telefon\\w*|tel[eé]fono|t[eé]l[eé]phone",
}
AGAINST = {
    "email": "git|commit|version",
    "ip": "version|v|release|section|chapter|build|firmware",
    "card": "isbn|serial|order|invoice|tracking|sku|id|hash|account",
    "phone": "isbn|version|order|invoice|serial|sku|page|year|date",
}
_CUE = {k: re.compile(rf"\b(?:{CUES[k]})\b", re.IGNORECASE) for k in KINDS}
_AGAINST = {k: re.compile(rf"\b(?:{AGAINST[k]})\b", re.IGNORECASE) for k in KINDS}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    strict: bool   # has the strict shape
    sound: bool    # passes its arithmetic check
    form: int      # outer form, below FORMS


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) < 4 and int(bare or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        done = host.end() if host else at + 1  # a run before another @ cannot reach across this one
        if host:
            yield Span("email", start, done, True, True, 0)
        at = text.find("@", done)


def _phones(text: str) -> Iterator[Span]:
    at = text.find("+")
    while at >= 0:
        run = PHONE.match(text, at)
        end = at + len(run.group().rstrip(" ().-")) if run else 0
        if end >= at + 4:
            n = len(_digits(text[at:end]))
            yield Span("phone", at, end, True, 9 <= n <= 15, 1)
            at = text.find("+", end)
        else:
            at = text.find("+", at + 1)


def _numbers(text: str) -> Iterator[Span]:
    """Strict ip and card matches, and loose cards and phones, of every stretch of digits."""
    for chunk in NUMBERS.finditer(text):
        at, body = chunk.start(), chunk.group()
        if "." in body:
            for chain in DOTTED.finditer(body):
                parts, start = chain.group().split("."), at + chain.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i:i + 4]
                    end = start + sum(map(len, four)) + 3
                    yield Span("ip", start, end, True, all(map(_octet, four)), 2)
                    start = end + 1
        for chain in CARD.finditer(body):
            digits = _digits(chain.group())
            if 13 <= len(digits) <= 19:
                yield Span("card", at + chain.start(), at + chain.end(), True, luhn(digits), 3 + (len(chain.group()) > len(digits)))
        for m in LOOSE_CARD.finditer(body):
            yield Span("card", at + m.start(), at + m.end(), False, luhn(_digits(m.group())), 5)
        for m in LOOSE_PHONE.finditer(body):
            start, end, digits = at + m.start(), at + m.end(), _digits(m.group())
            if start and text[start - 1] == "(":
                start -= 1
            foreign = digits.startswith("00")
            sound = 9 <= len(digits.lstrip("0")) <= 15 if foreign else len(digits) == 10 and digits[0] > "1" and digits[3] > "1"
            yield Span("phone", start, end, False, sound, 6 if foreign else 7)


def _spelled(text: str) -> Iterator[Span]:
    if any(mark in text for mark in SPELLED_MARKS):
        done = 0
        for mark in AT.finditer(text):
            start = mark.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            host = SPELLED.match(text, mark.end()) if start < mark.start() else None
            # "at" as a plain word needs a spelled-out dot as well
            if host and (mark.group() != " at " or DOT_WORD.search(host.group())):
                done = host.end()
                yield Span("email", start, done, False, True, 1)
    if "[.]" in text or "(.)" in text:
        for m in DEFANGED.finditer(text):
            yield Span("ip", m.start(), m.end(), False, all(map(_octet, re.findall("[0-9]+", m.group()))), 3)
    if text.count(":") >= 7:
        for m in SIX.finditer(text):
            yield Span("ip", m.start(), m.end(), False, True, 4)


def base_spans(text: str) -> list[Span]:
    """The strict matches that pass their checks, by kind and start."""
    found = [s for scan in (_emails, _numbers, _phones) for s in scan(text) if s.strict and s.sound]
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def candidates(text: str) -> list[Span]:
    """All candidates, strict and loose, by start."""
    return sorted({s for scan in (_emails, _numbers, _phones, _spelled) for s in scan(text)}, key=lambda s: (s.start, s.end, s))


def _listed(s: Span, text: str) -> int:
    body = text[s.start:s.end]
    if s.kind == "email":
        return 1 if re.split(r"[^A-Za-z0-9-]+", body)[-1].lower() in DOMAINS else -1
    digits = _digits(body)
    if s.kind == "ip":
        if s.form == 4:
            return 0
        first = re.split(r"[^0-9]+", body)[0].lstrip("0")
        return -1 if first in ("", "1", "2", "3") else 1  # reserved block, and what versions start with
    if s.kind == "card":
        return 1 if ISSUERS.match(digits) else -1
    if s.form == 7:
        return -1 if digits[0] in "01" else 0
    return 1 if CALLING.match(digits.lstrip("0") if s.form == 6 else digits) else -1


def votes(spans: list[Span], text: str) -> list[tuple[int, ...]]:
    """One vote of each labeler (1 yes, -1 no, 0 none) for each span of a text."""
    out = []
    for i, s in enumerate(spans):
        before = text[max(0, s.start - 48):s.start]
        context = 1 if _CUE[s.kind].search(before) else -1 if _AGAINST[s.kind].search(before) else 0
        near = [spans[j] for j in (i - 1, i + 1) if 0 <= j < len(spans)]
        close = any(o.start - s.end < 100 and s.start - o.end < 100 and (o.end <= s.start or o.start >= s.end) for o in near)
        glued = text[s.start - 1:s.start].isalnum() or text[s.end:s.end + 1].isalnum()
        out.append((1 if s.strict else -1, 1 if s.sound else -1, _listed(s, text), context, -1 if glued else 1, 1 if close else 0))
    return out


def anchor(s: Span) -> int:
    """1 known to be true, 0 known to be false, -1 latent."""
    return 0 if not s.sound else 1 if s.strict else -1


Pattern = tuple[str, int, int, tuple[int, ...]]  # kind, anchor, form, votes


def patterns(text: str) -> list[tuple[Span, Pattern]]:
    spans = candidates(text)
    return [(s, (s.kind, anchor(s), s.form, v)) for s, v in zip(spans, votes(spans, text), strict=True)]


def estimate(counts: dict[Pattern, int], tolerance: float = 1e-9, rounds: int = 1000) -> tuple[dict[Pattern, float], dict[str, np.ndarray]]:
    """(probability of each pattern to be true, reliabilities) by expectation-maximisation.

    A kind's reliabilities are ``[class, labeler, vote + 1]``: how often a
    labeler gives each vote on false (0) and on true (1) spans."""
    truth, reliabilities = {}, {}
    for kind in KINDS:
        own = sorted(p for p in counts if p[0] == kind)
        if not own:
            continue
        n = np.array([counts[p] for p in own], float)
        fixed = np.array([p[1] for p in own], float)
        cast = np.array([p[3] for p in own], int) + 1
        hot = np.eye(3)[cast]  # pattern, labeler, vote
        p = np.where(fixed >= 0, fixed, 1 / (1 + np.exp(-cast.sum(1) + LABELERS)))  # start from the majority
        for _ in range(rounds):
            mass = np.stack([n * (1 - p), n * p])
            table = np.einsum("cp,plv->clv", mass, hot) + 1.0  # one vote of each sort for smoothing
            table /= table.sum(2, keepdims=True)
            prior = (mass.sum(1) + 1.0) / (mass.sum() + 2.0)
            logs = np.log(prior)[:, None] + np.einsum("clv,plv->cp", np.log(table), hot)
            new = np.where(fixed >= 0, fixed, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))
            change, p = float(np.abs(new - p).max()), new
            if change < tolerance:
                break
        truth |= dict(zip(own, p.tolist(), strict=True))
        reliabilities[kind] = table
    return truth, reliabilities


def features(p: Pattern) -> np.ndarray:
    """Votes and outer form, as indicators of the pattern's kind."""
    kind, _, form, vote = p
    x = np.zeros(len(KINDS) * (1 + FORMS + 3 * LABELERS))
    at = KINDS.index(kind) * (1 + FORMS + 3 * LABELERS)
    x[at] = x[at + 1 + form] = 1
    for i, v in enumerate(vote):
        x[at + 1 + FORMS + 3 * i + v + 1] = 1
    return x


def fit(counts: dict[Pattern, int], truth: dict[Pattern, float], ridge: float = 1e-3) -> np.ndarray:
    """Weights of the logistic span classifier, by Newton steps to convergence."""
    order = sorted(counts)
    size = len(KINDS) * (1 + FORMS + 3 * LABELERS)
    w = np.zeros(size)
    if not order:
        return w
    x = np.stack([features(p) for p in order])
    total = {k: sum(n for p, n in counts.items() if p[0] == k) for k in KINDS}
    n = np.array([counts[p] / total[p[0]] for p in order])  # every kind weighs the same
    y = np.array([truth[p] for p in order])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (n * (y - q)) - ridge * w
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(size), gradient)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


class Model(NamedTuple):
    weights: np.ndarray
    reliabilities: dict[str, np.ndarray]

    def score(self, p: Pattern) -> float:
        return 1 / (1 + math.exp(-float(np.clip(features(p) @ self.weights, -50, 50))))

    def spans(self, text: str, known: dict[Pattern, bool] | None = None) -> tuple[list[Span], list[Span]]:
        """(base, all) spans of a text, by kind and start."""
        known = {} if known is None else known
        found = patterns(text)
        base = [s for s, _ in found if s.strict and s.sound]
        taken = sorted((s.start, s.end) for s in base)
        added, reach, i = [], 0, 0  # what base spans before this one cover
        for s, p in found:
            if p[1] >= 0:
                continue
            while i < len(taken) and taken[i][0] < s.end:
                reach, i = max(reach, taken[i][1]), i + 1
            if s.start < reach:
                continue
            if p not in known:
                known[p] = self.score(p) >= 0.5
            if known[p]:
                added.append(s)
                reach = max(reach, s.end)
        by_kind = lambda s: (KINDS.index(s.kind), s.start, s.end)
        return sorted(base, key=by_kind), sorted(base + added, key=by_kind)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Reliabilities and classifier from the vote patterns of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for text in b.column(0):
                found.update(p for _, p in patterns(text.as_py() or ""))
            rows = list(found.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p, _ in rows], pa.string()), pa.array([p[1] for p, _ in rows], pa.int32()),
                 pa.array([p[2] for p, _ in rows], pa.int32()), pa.array([list(p[3]) for p, _ in rows], pa.list_(pa.int32())),
                 pa.array([n for _, n in rows], pa.int64())], ["kind", "known", "form", "votes", "n"])
    cast = (docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
                .mapInArrow(run, "kind string, known int, form int, votes array<int>, n long"))
    rows = cast.groupBy("kind", "known", "form", "votes").agg(F.sum("n").alias("n")).collect()  # at most MAX_PATTERNS rows
    counts = {(r.kind, r.known, r.form, tuple(r.votes)): r.n for r in rows}
    truth, reliabilities = estimate(counts)
    return Model(fit(counts, truth), reliabilities)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans), one row per document.

    The counts and ``base`` are of base spans; ``spans`` has the added ones too.
    Both are ``kind:start:end`` (code points, end exclusive) by kind, then start."""
    model = model or train(docs, text_col)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def told(spans: list[Span]) -> str:
        return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[Pattern, bool] = {}
        for b in batches:
            n, base, every = [], [], []
            for text in b.column(1):
                mine, more = model.spans(text.as_py() or "", known)
                kinds = Counter(s.kind for s in mine)
                n.append([kinds[k] for k in KINDS])
                base.append(told(mine))
                every.append(told(more))
            counts = [pa.array([r[i] for r in n], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(base, pa.string()), pa.array(every, pa.string())],
                                             ["id", *(f"n_{k}" for k in KINDS), "base", "spans"])
    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {id_type}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
