"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that can end its encoding. It is the vocabulary match ending
there (found by an automaton over all tokens) whose neighbour, the stored last token of the shorter prefix, stays apart
from it under the merge rules. Following the stored tokens back from the end gives the ids. Time is the length of a piece
times that of the longest token at most; nothing is merged step by step.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, memory, table, texts

# Fixed value: the public pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAIRS = 1_000_000  # remembered neighbour tests
PORTION = 1 << 20  # tokens that leave a worker at a time
LONGEST = 100  # characters of a stretch worth remembering
DEEP = 200  # bytes of a piece whose prefixes are looked at only when asked for, one call deep each
HEADS, HEAD = 200_000, 8  # remembered beginnings of pieces, and their bytes at most
LATIN = "\u024f"  # up to here the letters of `str.isalpha` are those of the pattern, whatever the Unicode version
ALONE = ("", -1, "")  # marks a stretch that must be split together with its neighbours


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable bytes are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Encoder:
    def __init__(self, path: str, limit: int = 500_000) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        bytes_of = lambda s: bytes(letters[c] for c in s)
        self.of_bytes = {bytes_of(t): i for t, i in spec["model"]["vocab"].items()}
        self.token = {i: t for t, i in self.of_bytes.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: (rank, left part, right part)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (self.of_bytes[bytes_of(x)] for x in (a, b))
            self.rank.setdefault((left, right), r)
            self.made.setdefault(self.of_bytes[bytes_of(a + b)], (r, left, right))
        # The suffix automaton: states are endings of tokens, read from the last byte backwards; state << 8 | byte -> state.
        self.step: dict[int, int] = {}
        self.accepts: list[int] = [-1]
        for raw, i in self.of_bytes.items():
            made = self.made.get(i)
            if made is not None and self.rank[made[1:]] != made[0]:
                continue  # its own text never encodes to it
            state = 0
            for byte in reversed(raw):
                state = self.step.setdefault(state << 8 | byte, len(self.accepts))
                if state == len(self.accepts):
                    self.accepts.append(-1)
            self.accepts[state] = i
        self.split = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.limit, self.known = limit, {}
        self.apart: dict[int, bool] = {}
        self.heads: dict[bytes, list[int]] = {}  # ids of beginnings, from the last on
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.size = {i: len(t) for i, t in self.token.items()}
        self.decimal = {i: str(i) for i in self.token}
        self.right_spine, self.left_spine = lru_cache(1 << 16)(lambda t: self._spine(t, 2)), lru_cache(1 << 16)(lambda t: self._spine(t, 1))

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(part, rank at which it is taken into a larger part) down one edge of a token."""
        out, until = [(token, float("inf"))], self.made.get(token)
        while until:
            out.append((until[side], until[0]))
            until = self.made.get(until[side])
        return out

    def _apart(self, left: int, right: int) -> bool:
        """Would the two tokens, written side by side, stay two tokens?

        They would not if some part on the right edge of `left` merges with some part on the left edge of `right` before
        either is taken in; of equal ranks the pair further left is merged first.
        """
        for a, a_until in self.right_spine(left):
            for b, b_until in self.left_spine(right):
                r = self.rank.get((a, b))
                if r is not None and r < a_until and r <= b_until:
                    return False
        return True

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token. A short one looks only at the prefixes its tokens lead to, a long one at all in turn."""
        last = [-1] * (len(raw) + 1)
        for end in (len(raw),) if len(raw) <= DEEP else range(1, len(raw) + 1):
            self._ending(raw, last, end)
        return self._back(raw, last, len(raw))[::-1]

    def _back(self, raw: bytes, last: list[int], at: int) -> list[int]:
        """Ids of the first `at` bytes from the last on, along the tokens kept in `last` to a remembered beginning."""
        ids = []
        while at:
            token = last[at]
            if token < 0:
                return ids + self._head(raw, last, at)
            ids.append(token)
            at -= self.size[token]
        return ids

    def _head(self, raw: bytes, last: list[int], end: int) -> list[int]:
        """`_back` of a short beginning; pieces begin alike, so it is remembered."""
        head = raw[:end]
        ids = self.heads.get(head)
        if ids is None:
            self._ending(raw, last, end)
            ids = self._back(raw, last, end)
            if len(self.heads) >= HEADS:
                self.heads.clear()
            self.heads[head] = ids
        return ids

    def _ending(self, raw: bytes, last: list[int], end: int) -> int:
        """The token that ends the encoding of the first `end` bytes, kept in `last`."""
        step, accepts, state, at, found = self.step.get, self.accepts, 0, end, []
        while at:
            at -= 1
            state = step(state << 8 | raw[at])
            if state is None:
                break
            if accepts[state] >= 0:
                found.append((at, accepts[state]))
        for at, token in reversed(found):
            if not at:
                break
            before = last[at]
            if before < 0:
                before = self._head(raw, last, at)[0] if at <= HEAD else self._ending(raw, last, at)
            pair = before << 32 | token
            fits = self.apart.get(pair)
            if fits is None:
                fits = self._remember(pair, before, token)
            if fits:
                break
        last[end] = token
        return token

    def _remember(self, pair: int, left: int, token: int) -> bool:
        if len(self.apart) > PAIRS:
            self.apart.clear()
        self.apart[pair] = self._apart(left, token)
        return self.apart[pair]

    def _chunk(self, text: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, decoded text) of a stretch that pre-tokens don't cross."""
        word = text.removeprefix(" ")
        pieces = (text,) if word.isalpha() and (word.isascii() or max(word) <= LATIN) else self.split(text)
        if len(pieces) == 1:  # remembered as a stretch
            ids = self.encode_piece(text.encode())
        else:
            ids = []
            for piece in pieces:
                own = self.pieces.get(piece)
                if own is None:
                    if len(self.pieces) > self.limit:
                        self.pieces.clear()
                    own = tuple(self.encode_piece(piece.encode()))
                    if len(piece) <= LONGEST:
                        self.pieces[piece] = own
                ids += own
        decoded = b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")
        return ",".join(map(self.decimal.__getitem__, ids)), len(ids), text if decoded == text else decoded  # one string where they are equal

    def _parts(self, text: str) -> list[tuple[str, int, str]]:
        """Encoded stretches of a text without special tokens.

        A single blank between other signs always starts a pre-token, so what lies between blanks is encoded once and
        remembered by what follows its blank. A blank beside white space or at an edge does not; such texts are split by the
        pattern as a whole.
        """
        first, *rest = text.split(" ")
        out = list(map(self.known.get, rest))
        if None in out:
            if len(self.known) > self.limit:
                self.known.clear()
                out = [None] * len(rest)
            k = -1
            for _ in range(out.count(None)):
                k = out.index(None, k + 1)
                out[k] = self.known.get(rest[k]) or self._learn(rest[k])
        head = self._whole("", first)
        return [self._chunk(x) for x in self.split(text)] if ALONE in out or head is ALONE else [head, *out]

    def _whole(self, blank: str, body: str) -> tuple[str, int, str]:
        return ALONE if not body or body[0].isspace() or body[-1].isspace() else self._chunk(blank + body)

    def _learn(self, body: str) -> tuple[str, int, str]:
        out = self._whole(" ", body)
        if len(body) < LONGEST:
            self.known[body] = out
        return out

    def encode(self, text: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, decoded text)."""
        if self.cut and any(s in text for s in self.special):
            out = []
            for k, part in enumerate(self.cut.split(text)):
                if part:
                    out += [(str(self.special[part]), 1, part)] if k % 2 else self._parts(part)
        else:
            out = self._parts(text) if text else []
        if not out:
            return "", 0, ""
        ids, n, decoded = zip(*out, strict=True)
        return ",".join(ids), sum(n), "".join(decoded)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file, with what it remembers."""
    known = memory("bpe")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


def _portions(enc: Encoder, batch, digest: bool, decode: bool):
    """Columns of some PORTION tokens each: ids in one flat array, so that no token is an object of its own."""
    rows, own, held = [], [], 0
    for doc, text in zip(batch.column(0), batch.column(1), strict=True):
        i, k, d = enc.encode(text.as_py())
        rows.append((doc.as_py(), k))
        if digest:
            own.append((hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()))
        else:
            own.append((np.fromstring(i, np.int32, sep=",") if i else np.zeros(0, np.int32), d if decode else None))
            held += k + len(d) // 4
        if held >= PORTION:
            yield _columns(rows, own, digest)
            rows, own, held = [], [], 0
    if rows:
        yield _columns(rows, own, digest)


def _columns(rows: list, own: list, digest: bool) -> dict:
    ids = [x[0] for x in own]
    if not digest:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
    return {"doc_id": [r[0] for r in rows], "n_tokens": [r[1] for r in rows], "ids": ids, "decoded": [x[1] for x in own]}


def bpe_encode(docs: DataFrame, path: str | None = None, digest: bool = False, decode: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text; with `digest` SHA-256 of ids and decoded text in their stead;
    without `decode` the decoded text is null.

    One scan, no shuffle. Repeated rows give repeated rows; an empty table gives none. `path` must be a place every executor
    can read. Null and empty texts have no tokens and decode to
    an empty text; special tokens written in a text are those tokens; a null doc_id is encoded like any other; other
    columns are ignored; texts of any length are encoded whole.
    """
    path = path or default_vocabulary()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield from _portions(enc, b, digest, decode)

    return map_rows(texts(docs), run, f"doc_id long, n_tokens long, ids {'string' if digest else 'array<int>'}, decoded string", "bpe")


def op7(spark, sf_dir):
    d = bpe_encode(table(spark, sf_dir, "documents"), digest=True)
    return d.select("doc_id", "n_tokens", d.ids.alias("ids_sha256"), d.decoded.alias("decoded_sha256"))
