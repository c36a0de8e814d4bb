"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A piece of this model never has a word mark after another character, so merges
stay inside words and each distinct word is encoded once. All new words of a
batch lie in one flat symbol array. A round looks up the rank of every adjacent
pair, takes the least rank of each word, merges the pairs of that rank from the
left, and compacts the arrays; words without a pair leave. Equal to merging one
pair at a time as long as the merged piece can't at once enter a better merge;
for pieces that can (``eager``), a round merges the leftmost pair only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.memory import trim
from studyloom.llm.storage import with_columns

MARK = "▁"
#: Distinct words kept by a worker before it starts anew; bounds its memory.
CACHE_WORDS = 200_000
#: Characters of new words merged at once; bounds the size of the flat arrays.
MERGE_CHARS = 120_000


class PieceModel:
    """Vocabulary and merge table of a BPE model file."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.n = n
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int64)
        self.kind = np.zeros(n, np.int8)  # 0 text, 1 byte, 2 control, 3 unknown
        scores = np.zeros(n)
        ids: dict[str, int] = {}
        for i, p in enumerate(pieces):
            scores[i] = sp.get_score(i)
            if sp.is_byte(i):
                self.kind[i], self.byte_id[int(p[3:5], 16)] = 1, i
            elif sp.is_control(i):
                self.kind[i] = 2
            elif sp.is_unknown(i):
                self.kind[i] = 3
            else:
                ids[p] = i
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces that cross words need another encoder")
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        self.ids = ids
        order = sorted(ids.values(), key=lambda i: (-scores[i], i))
        rank = np.zeros(n, np.int64)
        last, r = None, -1
        for i in order:
            r += scores[i] != last
            last, rank[i] = scores[i], r
        left, right, made = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        left, right, made = np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int64)
        eager = np.zeros(n, bool)
        for part in (left, right):
            eager[part[rank[made] <= rank[part]]] = True
        self.rank, self.eager = rank, eager
        # Open addressing with linear probing, looked up by whole arrays.
        self.bits = max(8, int(np.ceil(np.log2(max(4, 4 * len(made))))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.zeros(1 << self.bits, np.int32)
        todo, value, at = left * (n + 1) + right, made, None
        at = self._slot(todo)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at] < 0
            self.keys[at[free]] = todo[free]  # of several, the last one wins
            won = self.keys[at] == todo
            self.vals[at[won]] = value[won]
            todo, value, at = todo[~won], value[~won], (at[~won] + 1) & ((1 << self.bits) - 1)
        # What each id decodes to.
        text = [b"" if self.kind[i] == 2 else " ⁇ ".encode() if self.kind[i] == 3 else bytes([int(p[3:5], 16)]) if self.kind[i] == 1 else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.out_len = np.array([len(x) for x in text], np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)[:-1]])
        self.out = np.frombuffer(b"".join(text), np.uint8)
        self.char_ids = {p: i for p, i in ids.items() if len(p) == 1}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(-7046029254386353131)) >> np.int64(20)) & ((1 << self.bits) - 1)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = left * (self.n + 1) + right
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.vals[at], -1)
        for _ in range(self.probes):
            more = np.flatnonzero((got != key) & (got >= 0))
            if not len(more):
                break
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            got[more] = self.keys[at[more]]
            hit = more[got[more] == key[more]]
            out[hit] = self.vals[at[hit]]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has.
        A word starts with its marks, if it has any."""
        chars = "".join(words)
        code = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        kinds, back = np.unique(code, return_inverse=True)
        known = np.array([self.char_ids.get(chr(c), -1) for c in kinds], np.int64)
        sym = known[back] if len(kinds) else np.zeros(0, np.int64)
        gone = np.flatnonzero(sym < 0)
        if len(gone):  # byte fallback: these never merge
            spelled = [[int(self.byte_id[b]) for b in chr(c).encode("utf-8", "replace")] for c in code[gone]]
            count = np.ones(len(sym), np.int64)
            count[gone] = [len(x) for x in spelled]
            first = np.cumsum(count) - count
            sym, word = np.repeat(sym, count), np.repeat(word, count)
            for k, at in enumerate(first[gone]):
                sym[at : at + len(spelled[k])] = spelled[k]
        place = np.arange(len(sym))  # order of what is done already
        done_sym, done_word, done_place = [], [], []
        while len(sym) > 1:
            made = np.where(word[1:] == word[:-1], self._merged(sym[:-1], sym[1:]), -1)
            best = np.where(made >= 0, self.rank[made], np.iinfo(np.int64).max)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(np.r_[best, np.iinfo(np.int64).max], start)
            size = np.diff(np.r_[start, len(sym)])
            live = least < np.iinfo(np.int64).max
            if not live.all():
                keep = np.repeat(live, size)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                done_place.append(place[~keep])
                pair = keep[:-1] & keep[1:]
                # a word is kept whole, so pairs inside kept words stay neighbours
                inner = np.flatnonzero(keep)
                sym, word, place = sym[inner], word[inner], place[inner]
                if len(sym) < 2:
                    break
                full_made = np.full(len(keep), -1, np.int64)
                full_made[: len(pair)][pair] = made[pair]
                made = full_made[inner][:-1]
                best = np.where(made >= 0, self.rank[made], np.iinfo(np.int64).max)
                least, size = least[live], size[live]
            at = np.flatnonzero((best == np.repeat(least, size)[:-1]) & (made >= 0) & (word[1:] == word[:-1]))
            # of a run of overlapping pairs every other one, from the left
            new = np.r_[True, np.diff(at) != 1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            # eager pieces: the leftmost pair of each word only
            lead = np.r_[True, word[at][1:] != word[at][:-1]]
            at = at[lead | ~np.repeat(self.eager[made[at]][lead], np.diff(np.r_[np.flatnonzero(lead), len(at)]))]
            sym = sym.copy()
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, place = sym[stay], word[stay], place[stay]
        done_sym.append(sym)
        done_word.append(word)
        done_place.append(place)
        sym, word, place = (np.concatenate(x) for x in (done_sym, done_word, done_place))
        order = np.argsort(place, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of the id lists that begin at ``starts`` (its last entry is the end)."""
        length = self.out_len[ids]
        end = np.cumsum(length)
        at = np.repeat((self.out_at[ids] - (end - length)).astype(np.int32), length) + np.arange(int(end[-1]) if len(end) else 0, dtype=np.int32)
        flat = self.out[at].tobytes()
        edge_all = np.r_[0, end]
        edge = edge_all[starts]
        kind = self.kind[ids]
        odd = bool((kind != 0).any())
        texts = []
        for k in range(len(starts) - 1):
            a, b = int(edge[k]), int(edge[k + 1])
            if starts[k] < starts[k + 1]:
                first = starts[k]
                while odd and first < starts[k + 1] and kind[first] == 2:
                    first += 1
                if first < starts[k + 1] and kind[first] == 0 and flat[a : a + 1] == b" ":
                    a += 1  # the mark that encoding has put before the text
            if odd and (kind[starts[k] : starts[k + 1]] == 2).any():  # a control id also ends a run of bytes
                cuts = [a, *(c for c in edge_all[np.flatnonzero(kind[starts[k] : starts[k + 1]] == 2) + starts[k]].tolist() if c > a), b]
                texts.append("".join(_utf8(flat[c:d]) for c, d in zip(cuts, cuts[1:])))
            else:
                texts.append(_utf8(flat[a:b]))
        return texts


def _utf8(raw: bytes) -> str:
    """Each byte that is not part of valid UTF-8 becomes one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for k in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


class _Index(dict):
    """Numbers words in the order in which they come; ``new`` has those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes texts; remembers the words it has met, up to CACHE_WORDS."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat = [np.zeros(0, np.int32)]
        self.sizes = [np.zeros(0, np.int64)]

    def _learn(self, words: list[str]) -> None:
        batch, chars = [], 0
        for w in words:
            if chars and chars + len(w) > MERGE_CHARS:
                self._add(batch)
                batch, chars = [], 0
            batch.append(w)
            chars += len(w)
        if batch:
            self._add(batch)

    def _add(self, batch: list[str]) -> None:
        ids, count = self.model.encode_words([w.replace(" ", MARK) for w in batch])
        self.flat.append(ids)
        self.sizes.append(count)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        per, seq, index = [], [], self.index
        for t in texts:
            words = split_words(t) if t else []
            per.append(len(words))
            seq.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        if index.new:
            self._learn(index.new)
            index.new = []
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        flat, sizes = self.flat[0], self.sizes[0]
        first = np.cumsum(sizes) - sizes
        which = np.concatenate(seq) if seq else np.zeros(0, np.int64)
        n = sizes[which]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        ids = flat[np.repeat((first[which] - (end - n)).astype(np.int32), n) + np.arange(total, dtype=np.int32)]
        edge = np.r_[0, np.cumsum(per)].astype(np.int64)
        return ids, np.diff(np.r_[0, end][edge])


def split_words(text: str) -> list[str]:
    """A blank is put before the text; a word is a run of blanks (or marks, which
    are the same to the model) and the characters up to the next one."""
    if MARK in text:
        text = text.replace(MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return [" " + p for p in parts]
    words, blanks = [], 0
    for p in parts:
        blanks += 1
        if p:
            words.append(" " * blanks + p)
            blanks = 0
    if blanks:
        words.append(" " * blanks)
    return words


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per worker and model file, kept between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(PieceModel(path))
    return _ENCODERS[path]


def _slices(texts: list, chars: int = 1_500_000):
    """Parts of a batch with at most so many characters, or one text."""
    a, n = 0, 0
    for b, t in enumerate(texts):
        if b > a and n + len(t or "") > chars:
            yield texts[a:b]
            a, n = b, 0
        n += len(t or "")
    yield texts[a:]


def encode_pieces(text: Column, model_file: str) -> Column:
    """array<int> of ids of each text, without begin or end ids; null counts as
    empty, and empty gives an empty array. ``model_file`` is read by each worker."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encode(column: pa.Array) -> pa.Array:
        enc = _encoder(model_file)
        made, row = [], 0
        while row < len(column) or not made:  # some hundred texts at once
            part = column.slice(row, 500)
            row += 500
            coded = [enc.encode(texts) for texts in _slices(part.to_pylist())]
            ends = np.cumsum(np.concatenate([c[1] for c in coded]))
            made.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate([c[0] for c in coded]))))
        out = pa.concat_arrays(made)
        trim()
        return out

    return encode(text)


def decode_pieces(ids: Column, model_file: str) -> Column:
    """Text of each id list; null and empty give the empty text. Ids outside
    the vocabulary raise."""

    @F.arrow_udf(T.StringType())
    def decode(column: pa.Array) -> pa.Array:
        model = _encoder(model_file).model
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() >= model.n):
            raise ValueError("an id is outside the vocabulary")
        lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.cumsum(lens)].astype(np.int64)
        texts, a = [], 0
        while a < len(lens):  # some hundred thousand ids at once
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + 400_000, "right")) - 1)
            texts.append(pa.array(model.decode(flat[starts[a] : starts[b]], starts[a : b + 1] - starts[a]), pa.string()))
            a = b
        out = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
        trim()
        return out

    return decode(ids)


def encode_documents(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """One row per row of ``docs``, all its columns and ``ids`` and ``decoded``.

    Null text is taken as empty (no ids, empty decoded text); repeated rows stay
    repeated; an empty table gives an empty table; columns of ``docs`` named
    ``ids`` or ``decoded`` are replaced."""
    coded = with_columns(docs, {"ids": encode_pieces(F.col(text), model_file)})
    return with_columns(coded, {"decoded": decode_pieces(F.col("ids"), model_file)})
