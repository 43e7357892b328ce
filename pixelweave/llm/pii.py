"""Personal data: fixed patterns, and further spans found by weak supervision.

Candidates are tokens with digits outside the fixed matches. Five labelers (two shapes, a gazetteer, the words before, the
kind of document part) vote +1, -1 or abstain. Votes and a small grid of features are counted over all documents; on these
counts expectation-maximisation estimates each labeler's reliability without any label, and a logistic span classifier is
trained on the posteriors. It decides every candidate from its features alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_rows, table, texts

KINDS = ("email", "ip", "card", "phone", "secret")  # order of kinds that start at one place

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from @ to @: the longest local part on the left, then the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all fixed matches, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(x) <= 255 if len(x) < 4 else not x.strip("0")[3:] and int(x[-3:]) <= 255 and not x[:-3].strip("0") for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


# Weak supervision. Words and prefixes the labelers know.
_CANDIDATE = re.compile(r"(?<![\w@.+-])[A-Za-z0-9][\w.+/=-]{4,}")
_VALUE = re.compile(r"[^=]*=")
_KEY_SHAPE = re.compile(r"[A-Z]{3,5}[A-Z0-9]{12,}$|[0-9a-f]{16,}$|[0-9]{3}-[0-9]{2}-[0-9]{4}$|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
_PLAIN_SHAPE = re.compile(r"[0-9]{1,4}([.,/-][0-9]{1,4}){0,2}[a-z]{0,2}$|v[0-9.]+$|[0-9]{4}-[0-9]{2}-[0-9]{2}")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "glpat-", "password=", "token=", "secret=", "api_key=", "passwd=", "pwd=")
_BEFORE_YES = frozenset("password passwd pwd token secret key apikey api_key ssn iban passport account id login user".split())
_BEFORE_NO = frozenset("version page chapter section figure table year vol no step line".split())
_FILE = re.compile(r"\.(html?|php|js|css|png|jpe?g|gif|pdf|txt|zip)$|^www\.|://")
_LAST_WORD = re.compile(r"(\w+)\W{0,6}$")
N_LABELERS = 5


def _votes(token: str, before: str) -> tuple[int, ...]:
    value = _VALUE.sub("", token)
    m = _LAST_WORD.search(before)
    word = m.group(1).lower() if m else ""
    n_digit, n_alpha = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    return (1 if _KEY_SHAPE.match(value) else -1 if _PLAIN_SHAPE.match(value) else 0,
            1 if token.startswith(_PREFIXES) else 0,
            1 if word in _BEFORE_YES else -1 if word in _BEFORE_NO else 0,
            1 if n_digit >= 3 and n_alpha >= 3 and len(value) >= 12 else -1 if n_digit + n_alpha < 8 else 0,
            -1 if _FILE.search(token) else 0)


def _cell(token: str, before: str) -> int:
    """Features of a candidate as one of 5 * 4 * 2 * 2 * 2 * 3 cells."""
    value = _VALUE.sub("", token)
    m = _LAST_WORD.search(before)
    word = m.group(1).lower() if m else ""
    digits = sum(c.isdigit() for c in value) / max(len(value), 1)
    parts = ((5, min(len(value) // 6, 4)), (4, min(int(digits * 4), 3)), (2, any(c.isupper() for c in value)), (2, any(c.islower() for c in value)),
             (2, "=" in token), (3, 2 if word in _BEFORE_YES else 1 if word in _BEFORE_NO else 0))
    cell = 0
    for size, k in parts:
        cell = cell * size + int(k)
    return cell


CELL_SIZES = (5, 4, 2, 2, 2, 3)


def _design(cells: np.ndarray) -> np.ndarray:
    cols, rest = [], cells.copy()
    for size in reversed(CELL_SIZES):
        cols.append(np.eye(size)[rest % size])
        rest //= size
    return np.concatenate([*cols, np.ones((len(cells), 1))], 1)


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over distinct vote rows with counts: (posterior per row, P(vote | class) [2, labeler, 3], prior)."""
    post = np.clip(0.5 + 0.2 * votes.sum(1), 0.05, 0.95)
    table_, prior = np.zeros((2, votes.shape[1], 3)), 0.5
    for _ in range(rounds):
        prior = float(np.clip((n * post).sum() / n.sum(), 1e-4, 1 - 1e-4))
        for c, p in ((0, n * (1 - post)), (1, n * post)):
            for k in range(votes.shape[1]):
                table_[c, k] = (np.bincount(votes[:, k] + 1, p, 3) + [1.0, 1.0, 1.0]) / (p.sum() + 3)
        log = [np.log(w) + sum(np.log(table_[c, k, votes[:, k] + 1]) for k in range(votes.shape[1])) for c, w in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table_, prior


def span_classifier(cells: np.ndarray, post: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic weights over the one-hot features, fitted to soft labels."""
    x, w = _design(cells), np.zeros(sum(CELL_SIZES) + 1)
    scale = n / n.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hess, x.T @ (scale * (post - p)) - 1e-4 * w), -3, 3)
    return w


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): fixed matches and voted candidates of every text, in one scan."""

    def run(batches):
        for b in batches:
            base, more = [], []
            for text in b.column(1).to_pylist():
                spans = base_spans(text)
                starts, own = sorted(s for s, _, _ in spans), []
                reach = list(accumulate((e for _, _, e in sorted(spans)), max))  # furthest end of the spans up to each start
                for m in _CANDIDATE.finditer(text) if _DIGIT.search(text) else ():
                    s, e = m.start(), m.end()
                    while e > s and text[e - 1] in ".-/=+":
                        e -= 1
                    token = text[s:e]
                    k = bisect_left(starts, e)
                    if (k and reach[k - 1] > s) or not any(c.isdigit() for c in token):
                        continue
                    before = text[max(0, s - 40):s]
                    votes = 0
                    for v in _votes(token, before):
                        votes = votes * 3 + v + 1
                    own.append({"start": s, "end": e, "votes": votes, "cell": _cell(token, before)})
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                more.append(own)
            yield {"doc_id": b.column(0), "base": base, "more": more}

    return map_rows(texts(docs), run, "doc_id long, base array<struct<start:int,kind:int,end:int>>, more array<struct<start:int,end:int,votes:int,cell:int>>")


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end); `kind` numbers KINDS, `spans` holds base and accepted candidates.

    Null and empty texts have none; a null doc_id is scanned like any other; repeated rows give repeated rows; other columns
    are ignored. The candidates of all documents are staged once (a few bytes each); the only thing the driver sees are
    counts per (votes, cell), at most 3^5 * 480 rows.
    """
    found = stage(find_candidates(docs))
    counts = found.select(F.explode("more").alias("m")).groupBy("m.votes", "m.cell").agg(F.count(F.lit(1)).alias("n")).collect()
    accepted = []
    if counts:
        codes, cells, n = (np.array(x) for x in zip(*((r.votes, r.cell, r.n) for r in counts), strict=True))
        votes = np.stack([codes // 3 ** k % 3 - 1 for k in reversed(range(N_LABELERS))], 1)
        post, _, _ = reliabilities(votes, n.astype(float))
        w = span_classifier(cells, post, n.astype(float))
        distinct = np.unique(cells)
        accepted = [int(c) for c in distinct[_design(distinct) @ w >= 0]]
    more = F.transform(F.filter("more", lambda m: m["cell"].isin(accepted)), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("secret")).alias("kind"), m["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(k: int):
    # a second parameter, also one with a default, would be bound to the index of the element
    return lambda s: s["kind"] == k


def op2(spark, sf_dir):
    d = pii_spans(table(spark, sf_dir, "documents"))
    n = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return d.select("doc_id", *n, F.sha2(F.encode(_joined(F.col("base")), "utf-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
