"""Token counts (operator 10): unigram segmentation scores once per shared prefix of a trie.

A pre-token is a run of bytes between spaces (0x20, 0x09-0x0D), with a word mark in front. Its segmentation is the one of highest
summed piece score under a unigram model; ties go to fewer tokens. A byte that no piece covers is a token by itself, at the
unknown score. Pieces and their scores come from a vocabulary file: piece of rank r (from 0) scores -log(r + 2), Zipf's law; nothing is trained.

The forward score of a prefix depends on the prefix alone. So the distinct pre-tokens of a batch go into a trie, here as their sorted list with
the length that each shares with the one before; walking it is a depth-first walk of the trie, and each trie node's forward score and token count are
computed once. The terminal's count is the pre-token's, and a document's is the sum over its words.

How it scales. Texts are read once and in place, no shuffle; a worker keeps terminal counts of at most ``most`` pre-tokens by 64-bit hash, then starts anew.

Cases. Null or empty text, or no words: 0 words, 0 tokens. Very long words: any length; the walk is linear in it times the longest piece. Repeated rows: each gets its row. Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, kept, pieces, utf8, words

MARK = "▁".encode()


class Unigram:
    """Piece scores and forward computation over the trie of sorted pre-tokens."""

    def __init__(self, path: str, unknown: float = -16.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i).encode(): -math.log(r + 2) for r, i in enumerate(usable)}
        self.unknown = unknown
        self.step: dict[int, int] = {}  # piece trie: node * 256 + byte -> node
        self.worth: list[float | None] = [None]
        for piece, s in self.score.items():
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(self.worth)
                    self.worth.append(None)
                node = self.step[key]
            self.worth[node] = s

    def count_all(self, tokens: list[bytes]) -> list[tuple[int, float]]:
        """Token count and score of each pre-token; tokens sorted. Nodes of shared prefixes are computed once."""
        out = []
        step, worth, unknown = self.step.get, self.worth, self.unknown
        # by depth of the present path: forward score, token count, and the pieces begun: (where, node of the piece trie)
        score, count, live = [0.0], [0], [[]]
        before, depth = b"", 0
        for t in tokens:
            shared = 0
            for a, b in zip(t, before, strict=False):
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], count[shared + 1 :], live[shared + 1 :]
            for depth in range(shared, len(t)):
                byte = t[depth]
                best, n = score[depth] + unknown, count[depth] + 1
                here = []
                for begin, node in live[depth]:
                    node = step(node << 8 | byte)
                    if node is not None:
                        here.append((begin, node))
                        s = worth[node]
                        if s is not None:
                            s += score[begin]
                            if s > best or (s == best and count[begin] + 1 < n):
                                best, n = s, count[begin] + 1
                node = step(byte)
                if node is not None:
                    here.append((depth, node))
                    s = worth[node]
                    if s is not None:
                        s += score[depth]
                        if s > best or (s == best and count[depth] + 1 < n):
                            best, n = s, count[depth] + 1
                score.append(best)
                count.append(n)
                live.append(here)
            out.append((count[-1], score[-1]))
            before = t
        return out


def _count(batches, path: str, most: int, block: int = 4 << 20):
    model = kept("unigram", path, Unigram)
    keys, counts, scores = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        n_words, n_tokens, total = [], [], []
        for i, j in pieces(offsets, block):
            b, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            start, length, h, first = words(b, o, lower=False)
            new, at, back = np.unique(h, return_index=True, return_inverse=True)
            place = np.searchsorted(keys, new)
            have = np.zeros(len(new), bool)
            if len(keys):
                have = keys[np.minimum(place, len(keys) - 1)] == new
            c, s = np.zeros(len(new), np.int64), np.zeros(len(new))
            c[have], s[have] = counts[place[have]], scores[place[have]]
            todo = np.flatnonzero(~have)
            if len(todo):
                raw = b.tobytes()
                tokens = [MARK + raw[x : x + y] for x, y in zip(start[at[todo]].tolist(), length[at[todo]].tolist(), strict=True)]
                order = sorted(range(len(tokens)), key=tokens.__getitem__)
                for k, (n, v) in zip(order, model.count_all([tokens[k] for k in order]), strict=True):
                    c[todo[k]], s[todo[k]] = n, v
                if len(keys) + len(todo) > most:
                    keys, counts, scores = keys[:0], counts[:0], scores[:0]
                merged = np.concatenate([keys, new[todo]])
                order = np.argsort(merged, kind="stable")
                keys, counts, scores = merged[order], np.concatenate([counts, c[todo]])[order], np.concatenate([scores, s[todo]])[order]
            ends, score_ends = np.r_[0, np.cumsum(c[back])], np.r_[0.0, np.cumsum(s[back])]
            n_words += np.diff(first).tolist()
            n_tokens += (ends[first[1:]] - ends[first[:-1]]).tolist()
            total += (score_ends[first[1:]] - score_ends[first[:-1]]).tolist()
        names = batch.schema.names
        keep = [k for k, n in enumerate(names) if n != "text"]
        yield pa.record_batch([batch.column(k) for k in keep] + [pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(total, pa.float64())], [*(names[k] for k in keep), "n_words", "n_tokens", "score"])


def token_counts(docs: DataFrame, model_path: str | None = None, most: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_tokens, score of each row of docs(doc_id, text)."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lambda it: _count(it, model_path, most), f"doc_id {kind}, n_words long, n_tokens long, score double")
