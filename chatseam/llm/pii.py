"""Personal data by weak supervision.

Spans of fixed patterns always count. Beyond them, wider patterns propose candidates, and several
weak labelers (pattern, gazetteer, context, shape) vote on all spans. Expectation-maximisation
estimates each labeler's reliability from how the votes agree over the whole corpus; its posteriors
train the span classifier that decides on the candidates. Both learn from counts of vote patterns,
of which there are a few hundred at most however large the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.llm.common import small_batches, stored, table
from chatseam.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape")

# Possessive, and from the start of a run of digits only: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")

_WIDE = {
    "email": re.compile(r"(?i)(?<![\w.+-])[a-z0-9._%+-]{1,64}+ ?[\[({]at[\])}] ?[a-z0-9-]{1,63}+(?: ?[\[({]dot[\])}] ?[a-z0-9-]{2,63}+){1,4}"),
    "card": re.compile(r"(?<![\d.])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\d.])"),
    "phone": re.compile(r"(?<![\d(+.-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![\d-])"),
}
_CONTEXT = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write|correo|courriel|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|addr|login)\b"),
    "card": re.compile(r"(?i)\b(card|visa|credit|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(phone|call|tel|fax|mobile|telefon|appel\w*|llam\w*)\b"),
}
# Top-level domains, card issuers and trunk codes that are common.
_DOMAINS = frozenset("com org net edu gov io co uk de fr es eu ru info".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65")
_CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each @, so that long runs without one cost nothing."""
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by kind and start; those that fail their test are dropped."""
    spans = [("email", *span) for span in _emails(text)]
    if any(c in text for c in "0123456789"):
        for match in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
                spans.append(("ip", *match.span()))
        for match in _CARD.finditer(text):
            if match.end() - match.start() >= 13 and 13 <= len(digits := _digits(match[0])) <= 19 and luhn(digits):
                spans.append(("card", *match.span()))
        if "+" in text:
            for match in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in match[0]) <= 15:
                    spans.append(("phone", *match.span()))
    return spans


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Matches of the wider patterns that touch no base span."""
    found = []
    for kind, pattern in _WIDE.items():
        if kind == "email" and "(" not in text and "[" not in text and "{" not in text:
            continue
        if kind == "phone" and "-" not in text:
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text) if all(m.end() <= a or m.start() >= b for _, a, b in taken)]
    return found


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 for no vote; in the order of LABELERS."""
    span, before = text[start:end], text[max(0, start - _CONTEXT_CHARS) : start]
    digits = _digits(span)
    if kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}"))[-1].lower() in _DOMAINS else -1
        shape = 1 if len(span) <= 80 else -1
    elif kind == "ip":
        gazetteer = -1 if span.split(".")[0] in ("0", "127", "255") else 0
        shape = 1 if len(span) <= 15 else -1
    elif kind == "card":
        gazetteer = 1 if _ISSUERS.match(digits) else -1
        shape = 1 if len(digits) in (15, 16) and luhn(digits) else -1
    else:
        gazetteer = 0
        shape = 1 if 10 <= len(digits) <= 12 and digits[-10:-9] not in ("0", "1") else -1
    return (1 if base else 0, gazetteer, 1 if _CONTEXT[kind].search(before) else 0, shape)


def labelled_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, spans``: kind (number), start, end, base, votes of every base and candidate span; code points, end exclusive."""
    kind_of = {kind: k for k, kind in enumerate(KINDS)}
    fields = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string())]

    @F.arrow_udf("array<struct<kind: int, start: int, end: int, base: boolean, votes: string>>")
    def label(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            text = text or ""
            base = base_spans(text)
            every = [(span, True) for span in base] + [(span, False) for span in candidates(text, base)]
            out.append(
                [
                    {"kind": kind_of[k], "start": a, "end": b, "base": is_base, "votes": ",".join(map(str, votes(text, k, a, b, is_base)))}
                    for (k, a, b), is_base in every
                ]
            )
        return pa.array(out, pa.list_(pa.struct(fields)))

    small_batches(documents.sparkSession)
    return documents.select("doc_id", label(F.col("text")).alias("spans"))


def reliabilities(ballots: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: posteriors of the patterns, and each labeler's vote chances by class.

    Starts from the majority. Prior votes keep a chance from 0 and 1; a labeler votes better than by
    chance to begin with, which tells the classes apart.
    """
    posterior = 1 / (1 + np.exp(-1.5 * ballots.sum(axis=1)))
    chances = np.zeros((2, ballots.shape[1], 3))
    for _ in range(rounds):
        prior = np.clip((posterior * counts).sum() / max(counts.sum(), 1), 0.05, 0.95)
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            for v in (-1, 0, 1):
                start = 1.0 + 2.0 * (v == (1 if c else -1))
                chances[c, :, v + 1] = (weight[:, None] * (ballots == v)).sum(axis=0) + start
        chances /= chances.sum(axis=2, keepdims=True)
        place = np.arange(ballots.shape[1])
        odds = np.log(chances[1][place, ballots + 1] / chances[0][place, ballots + 1]).sum(axis=1)
        posterior = 1 / (1 + np.exp(-np.clip(odds + np.log(prior / (1 - prior)), -50, 50)))
    return posterior, chances


def span_classifier(ballots: np.ndarray, posterior: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic regression on votes, trained on posteriors by Newton steps with a ridge."""
    x = np.c_[np.ones(len(ballots)), ballots].astype(float)
    w = np.zeros(x.shape[1])
    weight = counts / max(counts.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - posterior)) + 1e-3 * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def accepted_patterns(patterns: list[tuple[int, str, int]], threshold: float = 0.9) -> dict[int, list[str]]:
    """By kind: the vote patterns whose candidates the classifier takes."""
    accepted: dict[int, list[str]] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = sorted((v, n) for k, v, n in patterns if k == kind)
        ballots = np.array([[int(x) for x in v.split(",")] for v, _ in own])
        counts = np.array([n for _, n in own], dtype=float)
        posterior, _ = reliabilities(ballots, counts)
        weights = span_classifier(ballots, posterior, counts)
        chance = 1 / (1 + np.exp(-(np.c_[np.ones(len(ballots)), ballots] @ weights)))
        accepted[kind] = [v for (v, _), p in zip(own, chance, strict=True) if p >= threshold]
    return accepted


def find_personal_data(documents: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``doc_id, spans`` with ``kind, start, end, base`` of every base span and every accepted candidate.

    Null and empty texts have no spans. Texts are searched whole; every pattern takes time in
    proportion to the text. Repeated rows and null ids each come back as they are. Without any
    candidate, or with an empty table, only base spans (or nothing) come back.
    """
    labelled = stored(labelled_spans(documents))
    patterns = (
        labelled.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()
    )
    accepted = accepted_patterns([(r["kind"], r["votes"], r["n"]) for r in patterns], threshold)

    def stays(span: Column) -> Column:
        result = span["base"]
        for kind, chosen in accepted.items():
            if chosen:
                result |= (span["kind"] == kind) & span["votes"].isin(chosen)
        return result

    return labelled.select("doc_id", F.filter("spans", stays).alias("spans"))


def _joined(spans: Column) -> Column:
    """kind:start:end, by kind and start, comma-joined."""
    names = F.array(*(F.lit(kind) for kind in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _of_kind(spans: Column, kind: int) -> Column:
    # A second argument of the lambda, even one with a default, would be the place in the array.
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_of_kind(base, k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
