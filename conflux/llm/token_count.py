"""Numbers of tokens of documents under a unigram model, by dynamic programming over a trie of their words.

A task puts the distinct words it meets in a trie, level by level, and works out the best score of each node once: a
prefix that words share is scored once for all. What is found at the node where a word ends, its number of tokens, is kept
for later words of the task. The texts themselves aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from conflux.llm.tables import arrow_map, chunks, text_column

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Longer words aren't put in a trie or kept: each is segmented by itself, so many characters at a time.
LONGEST, STEP = 256, 1 << 16
# Words whose counts a task keeps; beyond that it starts anew, so memory is bounded.
KEPT = 400_000
TEXT_BYTES = 8_000_000
_SCALE = 1 << 20
_BASE = 0x100000001B3


def words_of(text: str | None) -> list[str]:
    """Runs of characters that are not white space."""
    return (text or "").split()


@dataclass(frozen=True)
class Unigram:
    """Pieces with whole-number scores, so that sums and ties are exact. A character no piece covers costs ``unknown`` and
    counts as its UTF-8 bytes."""

    pieces: list[str]
    scores: np.ndarray
    unknown: int

    @staticmethod
    def of(pieces: list[str]) -> Unigram:
        """Scores by Zipf's law from the pieces' ranks: the logarithm of one over the rank."""
        ranks = np.arange(1, len(pieces) + 1)
        scores = np.round(-np.log(ranks + 1.0) * _SCALE).astype(np.int64)
        return Unigram(pieces, scores, int(scores.min(initial=0)) - 10 * _SCALE)

    @staticmethod
    def read(path: str = TOKENIZER) -> Unigram:
        """The normal pieces of a SentencePiece file in its order."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        ids = [i for i in range(model.get_piece_size()) if not any(is_so(i) for is_so in special)]
        return Unigram.of([model.id_to_piece(i) for i in ids])

    @cached_property
    def by_length(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length, the pieces' hashes in order, their characters as rows, and their scores."""
        found: dict[int, list[int]] = {}
        for i, piece in enumerate(self.pieces):
            if piece:
                found.setdefault(len(piece), []).append(i)
        out = {}
        for length, numbers in sorted(found.items()):
            chars = np.frombuffer("".join(self.pieces[i] for i in numbers).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
            hashes = np.zeros(len(numbers), np.uint64)
            for k in range(length):
                hashes = hashes * np.uint64(_BASE) + chars[:, k]
            order = np.argsort(hashes, kind="stable")
            out[length] = hashes[order], chars[order], self.scores[numbers][order]
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of the best segmentation of each word, with a mark for the space before it; of equally good ones, the one with fewest tokens counts."""
        long = np.array([len(w) > LONGEST for w in words], bool)
        if long.any():
            out = np.empty(len(words), np.int64)
            out[long] = [self._count(w) for w in words if len(w) > LONGEST]
            out[~long] = self.counts([w for w in words if len(w) <= LONGEST])
            return out
        if not words:
            return np.empty(0, np.int64)
        words = [SPACE + w for w in words]
        order = sorted(range(len(words)), key=words.__getitem__)
        data = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(words[i]) for i in order], np.int64)
        offsets = np.cumsum(sizes) - sizes
        longest = max(self.by_length, default=1)
        powers = np.array([pow(_BASE, k, 1 << 64) for k in range(longest + 1)], np.uint64)

        # Levels of the trie: scores, tokens and hashes by node. The words still in play know their node at each level kept.
        levels = {0: (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64))}
        alive = np.arange(len(words))
        nodes = {0: np.zeros(len(words), np.int64)}
        tokens = np.zeros(len(words), np.int64)
        for depth in range(1, int(sizes.max()) + 1):
            keep = sizes[alive] >= depth
            if not keep.all():
                alive = alive[keep]
                nodes = {d: n[keep] for d, n in nodes.items()}
            char = data[offsets[alive] + depth - 1]
            parent = nodes[depth - 1]
            new = np.concatenate(([True], (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])))
            first = np.flatnonzero(new)
            c = char[first]
            width = np.select([c < 0x80, c < 0x800, c < 0x10000], [1, 2, 3], 4)
            score, count, hashes = levels[depth - 1]
            above = parent[first]
            best, fewest = score[above] + self.unknown, count[above] + width
            hashed = hashes[above] * np.uint64(_BASE) + c
            ends = offsets[alive[first]] + depth
            for length, (known, chars, scores) in self.by_length.items():
                if length > depth:
                    break
                score, count, hashes = levels[depth - length]
                above = nodes[depth - length][first]
                wanted = hashed - hashes[above] * powers[length]
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = np.flatnonzero(known[at] == wanted)
                if not len(hit):
                    continue
                # The hash of a piece is its own among the pieces; that the characters are the same is checked.
                spelled = data[ends[hit][:, None] + np.arange(-length, 0)]
                hit = hit[(spelled == chars[at[hit]]).all(axis=1)]
                s, n = score[above[hit]] + scores[at[hit]], count[above[hit]] + 1
                better = (s > best[hit]) | ((s == best[hit]) & (n < fewest[hit]))
                best[hit[better]], fewest[hit[better]] = s[better], n[better]
            levels[depth] = best, fewest, hashed
            nodes[depth] = np.cumsum(new) - 1
            if depth >= longest:
                levels.pop(depth - longest)
                nodes.pop(depth - longest)
            done = sizes[alive] == depth
            tokens[alive[done]] = fewest[nodes[depth][done]]
        out = np.empty(len(words), np.int64)
        out[order] = tokens
        return out

    def _count(self, word: str) -> int:
        """What ``counts`` says of one word: all pieces at each place, then the best way to each place in turn."""
        data = np.frombuffer((SPACE + word).encode("utf-32-le", "surrogatepass"), np.uint32)
        longest = max(self.by_length, default=1)
        # Score and tokens of the best way to the places from the present one on; None where there is none yet.
        ahead: list[tuple[int, int] | None] = [(0, 0)]
        for at in range(0, len(data), STEP):
            part = data[at : at + STEP + longest - 1]
            n = min(STEP, len(data) - at)
            starts, lengths, gains = [], [], []
            hashes = np.zeros(len(part), np.uint64)
            for length in range(1, min(longest, len(part)) + 1):
                hashes = hashes[: len(part) - length + 1] * np.uint64(_BASE) + part[length - 1 :]
                if length not in self.by_length:
                    continue
                known, chars, scores = self.by_length[length]
                wanted = hashes[:n]
                place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = np.flatnonzero(known[place] == wanted)
                hit = hit[(part[hit[:, None] + np.arange(length)] == chars[place[hit]]).all(axis=1)]
                starts.append(hit)
                lengths.append(np.full(len(hit), length))
                gains.append(scores[place[hit]])
            if starts:
                start = np.concatenate(starts)
                order = np.argsort(start, kind="stable")
                edges = list(zip(np.concatenate(lengths)[order].tolist(), np.concatenate(gains)[order].tolist(), strict=True))
                bounds = np.searchsorted(start[order], np.arange(n + 1)).tolist()
            else:
                edges, bounds = [], [0] * (n + 1)
            c = part[:n]
            widths = np.select([c < 0x80, c < 0x800, c < 0x10000], [1, 2, 3], 4).tolist()
            best = ahead + [None] * (n + longest + 1 - len(ahead))
            for i in range(n):
                score, tokens = best[i]
                ways = [(1, self.unknown, widths[i])]
                ways += [(length, gain, 1) for length, gain in edges[bounds[i] : bounds[i + 1]]]
                for length, gain, more in ways:
                    s, t, old = score + gain, tokens + more, best[i + length]
                    if old is None or s > old[0] or s == old[0] and t < old[1]:
                        best[i + length] = s, t
            ahead = best[n:]
        return ahead[0][1]


def token_counts(docs: DataFrame, model: Unigram, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, ``n_words`` and ``n_tokens`` of the whole text of every row; null and blank texts have none."""
    schema = docs.select(id_column).schema.add("n_words", "long").add("n_tokens", "long")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = text_column(batch, text)
            n_words, n_tokens = [], []
            for a, b in chunks([t or "" for t in texts], TEXT_BYTES):
                split = [words_of(t) for t in texts[a:b]]
                if len(known) > KEPT:
                    known.clear()
                new = list({w for words in split for w in words if w not in known})
                known.update(zip(new, shared.value.counts(new).tolist(), strict=True))
                n_words += [len(words) for words in split]
                n_tokens += [sum(map(known.__getitem__, words)) for words in split]
                for w in new:
                    if len(w) > LONGEST:
                        del known[w]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], schema.names
            )

    return arrow_map(docs.select(id_column, text), run, schema)
