"""Token counts under a unigram model, by dynamic programming over a trie of words.

The distinct pre-tokens of a batch go into a trie in sorted order: a word shares
the prefix it has in common with the word before, so the forward scores of that
prefix (best total score and fewest tokens of any split into pieces) are not
computed again. The counts at the ends of words are stored, and a document's
count is their sum.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.pieces import MARK, split_words
from studyloom.llm.storage import packed, unpacked

#: Distinct words whose counts a worker keeps before it starts anew.
CACHE_WORDS = 600_000
#: Scores are whole numbers of this part of a natural logarithm, so ties are exact.
UNIT = 1 << 20


@lru_cache(maxsize=4)
def unigram_scores(model_file: str) -> tuple[dict[str, int], int, int]:
    """Score of each piece, score of a byte, and the length of the longest piece.

    The pieces of a unigram model carry log probabilities. Those of a BPE model
    carry ranks only; they get Zipf's law, -log(1 + rank). A character that is
    no piece costs one token for each of its UTF-8 bytes, each scored below all pieces."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    text = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    score = {sp.id_to_piece(i): sp.get_score(i) for i in text}
    ranks = sorted(score, key=lambda p: (-score[p], p))
    if all(float(s).is_integer() for s in score.values()):
        score = {p: -math.log(1 + r) for r, p in enumerate(ranks, 1)}
    whole = {p: round(s * UNIT) for p, s in score.items()}
    return whole, min(whole.values()) - UNIT, max(map(len, whole))


class TrieCounter(dict):
    """Word to number of tokens; words not met before are counted by ``learn``."""

    def __init__(self, model_file: str):
        super().__init__()
        self.scores, self.byte, self.longest = unigram_scores(model_file)

    def learn(self, words: list[str]) -> None:
        get, longest = self.scores.get, self.longest
        # forward[k] belongs to the prefix of length k of the word at hand:
        # (-score, tokens), least first
        forward: list[tuple[int, int]] = [(0, 0)]
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del forward[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "replace"))
                cost, count = forward[end - 1]
                known = get(word[end - 1])
                best = (cost - known, count + 1) if known is not None else (cost - n * self.byte, count + n)
                for start in range(max(0, end - longest), end - 1):
                    s = get(word[start:end])
                    if s is not None:
                        cost, count = forward[start]
                        if (cost - s, count + 1) < best:
                            best = (cost - s, count + 1)
                forward.append(best)
            self[word] = forward[-1][1]
            before = word

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self) > CACHE_WORDS:
            self.clear()
        split = [[w.replace(" ", MARK) if w[1:2] == " " else MARK + w[1:] for w in split_words(t)] if t else [] for t in texts]
        self.learn(list({w for words in split for w in words if w not in self}))
        return [(len(words), sum(map(self.__getitem__, words))) for words in split]


_COUNTERS: dict[str, TrieCounter] = {}


def count_tokens(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_words (pre-tokens) and n_tokens.

    Null and empty texts have none; repeated rows stay repeated; an empty table
    gives an empty table; columns of ``docs`` with the new names are replaced.
    Rows are independent: nothing is shuffled."""

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    def run(column: pa.Array) -> pa.Array:
        if model_file not in _COUNTERS:
            _COUNTERS[model_file] = TrieCounter(model_file)
        texts = column.to_pylist()
        got = [x for a in range(0, len(texts), 1000) for x in _COUNTERS[model_file].count(texts[a : a + 1000])]
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["n_words", "n_tokens"])

    counted = packed(docs, run(F.col(text)).alias("counts"))
    return counted.select(*unpacked(docs.columns, "n_words", "n_tokens"), "counts.n_words", "counts.n_tokens")
