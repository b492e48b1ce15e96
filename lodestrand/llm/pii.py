"""PII by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) come from fixed patterns and always stand.
Beyond them, three families of labelers vote on candidate spans: patterns
(shapes of ids and secrets), a gazetteer (first names, key names) and context
(cue words just before). Candidates are all values that hold a digit or are
assigned to a key, and all runs of capitalised words that hold a first name or
follow a cue, so each labeler can vote either way or abstain. The votes of the
whole corpus are counted by pattern of votes and features, a table whose size is
bounded by the product of their values; expectation-maximisation on it
estimates each labeler's reliability without labels, for values and for names
apart, and its posteriors train a logistic span classifier. A second pass
extracts the spans and lets the classifier accept candidates.

Both passes are local to a row; only the count table is shuffled.

Defined cases: null is taken as empty and has no spans; texts of any length are
read whole, in time linear in their length; repeated rows are independent; with
no candidates at all the classifier accepts none; other columns pass through
`redacted` unchanged. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "id", "secret")
KINDS = BASE + ADDED

#: Fixed patterns of the base spans. Those of email are split at the @, so that long runs are read once.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: The gazetteer and the cue words.
FIRST_NAMES = frozenset("James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian Laura Anna Emma Julia Maria Pierre Jean Marie Claire Sophie Hans Klaus Peter Jürgen Ursula Carlos José Juan Luis Carmen Lucía".split())
KEY_NAMES = frozenset("token password passwd pwd secret key apikey api_key access_token auth bearer".split())
ID_NAMES = frozenset("ssn passport iban license account nif dni id tax insurance".split())
NAME_CUES = frozenset("mr mrs ms dr name called contact dear monsieur madame herr frau señor señora".split())
VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_/+=-]*")
ASSIGNED = re.compile(r"([A-Za-z_]{2,20})[\x20]?([:=])[\x20]?[\"']?\Z")
#: Where a candidate value may begin: at a digit, or after a sign of assignment.
ANCHOR = re.compile(r"[0-9]|(?<=[A-Za-z_])[\x20]?[:=][\x20]?[\"']?(?=[A-Za-z])")
SHAPES = (re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"), re.compile(r"(?=.*[0-9])[A-Za-z0-9_/+=-]{12,}"))
LETTERS = re.compile(r"[^\W\d_]+")
#: Up to four words with a Latin capital, one space apart.
RUN = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:\x20[A-ZÀ-ÖØ-Þ][^\W\d_]+){0,3}")
NAME_SIGNS = FIRST_NAMES | {form for w in NAME_CUES for form in (w, w.capitalize(), w.upper())}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds: leftmost and not overlapping within a kind; matches that fail their test are dropped."""
    found = []
    at = text.find("@")
    last = 0
    while at >= 0:
        low = at
        while low > last and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        m = DOMAIN.match(text, at) if low < at else None
        if m:
            found.append((low, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:3] or 0) <= 255 for x in m.group().split(".")):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str
    #: One vote per labeler: 1 personal, 0 not, -1 abstains.
    votes: tuple[int, ...]
    #: Coarse features that the classifier reads; few values each, so that their combinations stay few.
    features: tuple[int, ...]


LABELERS = ("shape", "entropy", "gazetteer", "context", "plain")


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[Candidate]:
    """Spans that the labelers vote on: values with a digit or a key, and runs of capitalised words with a first name or after a cue."""
    found, last = [], 0
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, b, _ in base), max))

    def is_taken(low: int, high: int) -> bool:
        """Whether a base span meets [low, high): of those that start before high, one ends after low."""
        before = bisect_left(starts, high)
        return before > 0 and reach[before - 1] > low

    for d in ANCHOR.finditer(text):
        low = d.start() if d.group().isdigit() else d.end()
        if low < last:
            continue
        while low > last and text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "_/+-"):
            low -= 1
        while low < d.start() and not text[low].isalnum():
            low += 1
        m = VALUE.match(text, low)
        last = m.end()
        if is_taken(low, last):
            continue
        value = m.group().rstrip("=/+-_")
        before = ASSIGNED.search(text, max(0, low - 26), low)
        key = before.group(1).lower() if before else ""
        known = key in KEY_NAMES or key in ID_NAMES
        digits, letters = sum(map(str.isdigit, value)), sum(map(str.isalpha, value))
        shape = next((k for k, p in enumerate(SHAPES) if p.fullmatch(value)), -1)
        mixed = digits >= 3 and letters >= 2 and len(value) >= 10
        votes = (
            1 if shape >= 0 else -1,
            1 if mixed else 0 if len(value) < 8 else -1,
            1 if known else 0 if before else -1,
            0 if not before else 1 if digits or before.group(2) == "=" else -1,
            0 if len(value) <= 5 or not letters and len(value) < 9 or not digits and not known else -1,
        )
        kind = "secret" if shape not in (0, 1) and (mixed or key in KEY_NAMES or not digits) else "id"
        found.append(Candidate(low, low + len(value), kind, votes, (1, min(len(value), 40) // 4, min(9, 10 * digits // max(1, len(value))), bool(before) + known, shape + 1)))
    if not NAME_SIGNS.isdisjoint(LETTERS.findall(text)):
        for m in RUN.finditer(text):
            low, own = m.start(), m.group().split(" ")
            said = LETTERS.findall(text[max(0, low - 24) : low].lower())[-2:]
            cue = not NAME_CUES.isdisjoint(said)
            while own and own[0].lower() in NAME_CUES:
                low, cue = low + len(own.pop(0)) + 1, True
            first = next((k for k, w in enumerate(own) if w in FIRST_NAMES), -1)
            if not own or first < 0 and not cue:
                continue
            low += sum(len(w) + 1 for w in own[: max(first, 0)])
            own = own[max(first, 0) :][:3]
            end = low + len(" ".join(own))
            if is_taken(low, end):
                continue
            full, ends_clause = len(own) > 1, text[end : end + 1] in (",", ".", ";", ":", ")", "")
            votes = (1 if full else -1, 0 if full and len(set(own)) == 1 else -1, int(first >= 0), int(cue), -1 if full or cue else 0)
            found.append(Candidate(low, end, "name", votes, (2, int(full), int(cue), int(first >= 0), int(ends_clause))))
    return sorted(found, key=lambda c: (c.start, c.end))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    #: By labeler, for values and for names ("name " before it): how often it is right on personal data, and on other spans.
    reliability: dict[str, tuple[float, float]]

    def accepts(self, c: Candidate) -> bool:
        return bool(self.weights) and float(np.dot(self.weights, vector(c.features))) >= 0.0


def vector(features: tuple[int, ...]) -> np.ndarray:
    """One-hot values of the coarse features, and a constant."""
    out = np.zeros(39)
    out[0] = 1.0
    family, a, b, c, d = features
    if family == 1:
        out[1] = 1.0
        out[2 + min(a, 10)] = 1.0
        out[13 + b] = 1.0
        out[23 + c] = 1.0
        out[26 + d] = 1.0
    else:
        out[30] = 1.0
        out[31 + a] = 1.0
        out[33 + b] = 1.0
        out[35 + c] = 1.0
        out[37 + d] = 1.0
    return out


def estimated(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns that occur n times: each pattern's posterior, and each labeler's reliability on either class."""
    cast = votes >= 0
    posterior = np.clip(np.where(cast, votes, 0).sum(1) / np.maximum(cast.sum(1), 1), 0.05, 0.95)
    hit = miss = np.full(votes.shape[1], 0.5)
    for _ in range(rounds):
        yes, no = n * posterior, n * (1 - posterior)
        # A Beta(8, 2) prior: a labeler is right more often than not, which fixes the meaning of the two classes.
        hit = (((votes == 1) * yes[:, None]).sum(0) + 8) / ((cast * yes[:, None]).sum(0) + 10)
        miss = (((votes == 0) * no[:, None]).sum(0) + 8) / ((cast * no[:, None]).sum(0) + 10)
        prior = np.clip((yes.sum() + 1) / (n.sum() + 2), 0.02, 0.98)
        log_yes = np.where(votes == 1, np.log(hit), np.where(votes == 0, np.log(1 - hit), 0)).sum(1) + np.log(prior)
        log_no = np.where(votes == 0, np.log(miss), np.where(votes == 1, np.log(1 - miss), 0)).sum(1) + np.log(1 - prior)
        posterior = 1 / (1 + np.exp(np.clip(log_no - log_yes, -50, 50)))
    return posterior, hit, miss


def fit(counts: list[tuple[tuple[int, ...], tuple[int, ...], int]]) -> Model:
    """EM over the vote patterns of values and of names, then one logistic regression on the features against the posteriors."""
    if not counts:
        return Model((), {})
    votes, n, family = np.array([v for v, _, _ in counts]), np.array([c for _, _, c in counts], float), np.array([f[0] for _, f, _ in counts])
    x, posterior, reliability = np.stack([vector(f) for _, f, _ in counts]), np.zeros(len(counts)), {}
    for k, name in ((1, ""), (2, "name ")):
        if (own := family == k).any():
            posterior[own], hit, miss = estimated(votes[own], n[own])
            reliability |= {name + who: (float(a), float(b)) for who, a, b in zip(LABELERS, hit, miss)}
    w, weight = np.zeros(x.shape[1]), np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(600):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w += 4.0 * (x.T @ (weight * (posterior - p)) - 1e-4 * w)
    return Model(tuple(w.tolist()), reliability)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Reliabilities and classifier from the candidates of all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches, text):
            for t in batch.column(0).to_pylist():
                if t:
                    found.update(",".join(map(str, c.votes + c.features)) for c in candidates(t, base_spans(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "n"])

    counted = docs.select(F.col(text)).mapInArrow(work, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = sorted((tuple(map(int, r.key.split(","))), r.n) for r in counted.collect())
    return fit([(k[: len(LABELERS)], k[len(LABELERS) :], n) for k, n in rows])


def spans(text: str | None, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, all) spans of one text, each sorted by start, then kind."""
    base = base_spans(text or "")
    added = [(c.start, c.end, c.kind) for c in candidates(text or "", base) if model.accepts(c)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def shown(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    model = model or train(docs, text)
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [spans(t, model) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
            shas = pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, shas, pa.array([shown(a) for _, a in found], pa.string())], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    out, last, open_end = [], 0, 0
    for a, b, kind in found:
        if a < open_end:
            open_end = last = max(open_end, b)
            continue
        out += [text[last:a], f"[{kind}]"]
        last = open_end = b
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs with personal data masked in their texts."""
    model = model or train(docs, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            where = batch.schema.get_field_index(text)
            texts = [t and masked(t, spans(t, model)[1]) for t in batch.column(where).to_pylist()]
            yield batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.column(where).type))

    return docs.mapInArrow(work, docs.schema)
