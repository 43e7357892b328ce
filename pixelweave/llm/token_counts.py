"""Unigram token counts: distinct pre-tokens share one trie, so a prefix is scored once.

Pre-tokens are white-space separated words behind a word mark. The score of a prefix under a unigram model (the largest
sum of piece log-probabilities over its segmentations, and the number of pieces of that segmentation) depends on shorter
prefixes alone. Visiting the words of a batch in sorted order walks their trie depth first: only the part below the
prefix shared with the word before is computed, and the count at the word's end is stored for every later occurrence.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import map_rows, memory, table, texts

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities of a vocabulary's pieces by their rank: the r-th of n pieces has 1 / (r * H_n)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}


class TrieCounter:
    """(log-probability, pieces) of words; a character outside the vocabulary is one piece for each of its bytes."""

    def __init__(self, scores: dict[str, float], limit: int = 600_000) -> None:
        self.scores, self.limit, self.known = scores, limit, {}
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0

    def learn(self, words: set[str]) -> None:
        """Visit new words in trie order and store what stands at their ends."""
        if len(self.known) > self.limit:
            self.known.clear()
        get, longest, unknown, known = self.scores.get, self.longest, self.unknown, self.known
        path, score, count = "", [0.0], [0]
        for word in sorted(words.difference(known)):
            text = MARK + word
            shared, most = 0, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del score[shared + 1:], count[shared + 1:]
            for end in range(shared + 1, len(text) + 1):
                size = len(text[end - 1].encode())
                best, pieces = score[end - 1] + unknown * size, count[end - 1] + size
                for at in range(max(0, end - longest), end):
                    own = get(text[at:end])
                    if own is not None and (score[at] + own > best or score[at] + own == best and count[at] + 1 < pieces):
                        best, pieces = score[at] + own, count[at] + 1
                score.append(best)
                count.append(pieces)
            path = text
            known[word] = (score[-1], count[-1])


def counter(path: str) -> TrieCounter:
    """One counter for each worker process and vocabulary, with what it remembers."""
    known = memory("token_counts")
    if path not in known:
        known[path] = TrieCounter(piece_scores(path))
    return known[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, log_prob) of every whole text; one scan, no shuffle.

    Null and empty texts have no words, no tokens and log-probability 0; a null doc_id is counted like any other; repeated
    rows give equal rows; other columns are ignored. `path` must be a place every executor can read.
    """
    path = path or default_model()

    def run(batches):
        c = counter(path)
        for b in batches:
            n_words, n_tokens, log_prob = [], [], []
            words = [t.split() for t in b.column(1).to_pylist()]
            c.learn(set().union(*words))
            for w in words:
                found = list(map(c.known.__getitem__, w))
                s, n = zip(*found, strict=True) if found else ((), ())
                n_words.append(len(w))
                n_tokens.append(sum(n))
                log_prob.append(float(sum(s)))
            yield {"doc_id": b.column(0), "n_words": n_words, "n_tokens": n_tokens, "log_prob": log_prob}

    return map_rows(texts(docs), run, "doc_id long, n_words long, n_tokens long, log_prob double", "token_counts")


def op10(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
