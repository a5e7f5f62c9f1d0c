"""Vector bin packing of tokenised documents into training sequences.

An example has three demands: tokens, segments (always 1) and loss-bearing
tokens. A sequence takes, again and again, the pending example whose demands
have the largest dot product with the room that is left and that fits every
limit; when none fits, a piece of the largest pending example fills the rest.
Each task packs its own rows as they stream by, with ``pending`` examples to
choose from, so nothing is shuffled and memory is bounded. A task's last tokens
go to sequences of powers of two, which need no padding.

Defined cases: a null text is empty and has the end token alone; repeated rows
are packed each; a null doc_id is kept; an empty table gives no rows; other
columns are not read. Sequence ids are unique over the whole result; they follow
from the input's split alone, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .tasks import record_batch, small_batches, worker_state

TOKENS, SEGMENTS = 4096, 1024
END_ID = 2
#: Pieces that a worker's memory keeps, and as many odd words; bytes of the longest.
KNOWN_WORDS, KNOWN_LENGTH = 200_000, 128
#: Bytes of text whose pieces are looked up together.
SLICE = 2 << 20
#: What stands for an odd word among the pieces; no piece holds it.
_ODD = b"\n"
_LATIN = [chr(c) for c in range(256)]
#: How the tokenizer tells characters up to U+00FF apart, in a fixed pattern of its file.
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
_KINDS = bytes(_BLANK if c in "\t\n\v\f\r \x85\xa0" else _LETTER if c.isalpha() else _NUMBER if c.isnumeric() else _OTHER for c in _LATIN)
_LOWER = bytes(ord(c.lower()) for c in _LATIN)


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memory:
    """What ``ask`` says of keys, both bytes and kept in Arrow arrays, with at most ``KNOWN_WORDS`` and one slice's keys."""

    def __init__(self, ask: Callable[[list[bytes]], list[bytes]]):
        self.ask = ask
        self.keys, self.values = pa.array([_ODD], pa.large_binary()), pa.array([b""], pa.large_binary())
        self.again = np.ones(1, bool)  # met again since it came or since the last time some were forgotten

    def find(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Values, and the place among them of each key's."""
        if len(self.keys) > KNOWN_WORDS:
            self._forget()
        values = self.values
        at = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().copy()
        self.again[at[at >= 0]] = True
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            numbered = keys.take(pa.array(unknown)).dictionary_encode()
            new, which = numbered.dictionary, numbered.indices.to_numpy()
            said = pa.array(self.ask(new.to_pylist()), pa.large_binary())
            at[unknown] = len(values) + which
            values = pa.concat_arrays([values, said])
            short = pc.less_equal(pc.binary_length(new), KNOWN_LENGTH)
            self.keys = pa.concat_arrays([self.keys, new.filter(short)])
            self.values = pa.concat_arrays([self.values, said.filter(short)])
            self.again = np.append(self.again, (np.bincount(which) > 1)[short.to_numpy(zero_copy_only=False)])
        return values, at

    def _forget(self) -> None:
        """Keeps keys met again, at most half of the memory, the oldest first; always the first."""
        self.again[0] = True
        kept = pa.array(np.flatnonzero(self.again)[:max(1, KNOWN_WORDS // 2)])
        self.keys, self.values = self.keys.take(kept), self.values.take(kept)
        self.again = np.zeros(len(kept), bool)


class WordTokenizer:
    """Ids of texts, the tokenizer's model asked once for each piece of a word.

    The tokenizer drops white space and lets no token cross it or a piece's end, so a
    text's ids are those of its pieces. Words of characters up to U+00FF are cut into
    pieces as the tokenizer cuts them (its normaliser only lower-cases them), all words
    of a slice at once, one byte a character. Arrow looks the pieces up among those known, kept
    in Arrow arrays; the distinct new ones go to the tokenizer's model, many in one call. All
    other words go through the whole tokenizer, each distinct new one once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it has
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)} | {10: "\n"}
        vocabulary = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        #: Strings that stand for an id of their own wherever they are, told apart by case.
        self.special = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.pieces, self.odd = _Memory(self._ask), _Memory(self._whole)

    def _whole(self, words: list[bytes], coding: str = "utf-32-le") -> list[bytes]:
        found = [coded.ids for coded in self.whole.encode_batch_fast([word.decode(coding) for word in words], add_special_tokens=False)]
        data = np.fromiter(chain.from_iterable(found), dtype="<u4").tobytes()
        ends = np.cumsum([4 * len(ids) for ids in found]).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _ask(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces in Latin-1 that the model sees as they are."""
        out: list[bytes] = []
        parts = [pieces[at:at + 200] for at in range(0, len(pieces), 200)]
        rows = [b"\n".join(part).decode("latin-1").translate(self.letters) for part in parts]
        for own, coded in zip(parts, self.model.encode_batch_fast(rows, add_special_tokens=False)):
            ids = np.array(coded.ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            # else a byte that the vocabulary lacks
            out += [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts)] if len(cuts) == len(own) else self._whole(own, "latin-1")
        return out

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null has none."""
        texts = [text or "" for text in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        if not texts:
            return []
        joined = "\n".join(texts) + "\n\n\n"
        special = [found.start() for token in self.special if token in joined for found in re.finditer(re.escape(token), joined)]
        try:
            chars, strange = joined.encode("latin-1"), bool(special)
        except UnicodeEncodeError:
            chars, strange = joined.encode("latin-1", "replace"), True  # one byte for each
        chars = chars.translate(_LOWER)
        kinds = np.frombuffer(chars.translate(_KINDS), np.uint8)
        chars = np.frombuffer(chars, np.uint8)
        begins, inside = _begins(chars, kinds), kinds != _BLANK
        if strange:
            wide = np.frombuffer(joined.encode("utf-32-le"), "<u4")
            odd = wide > 255
            odd[special] = True
            blanks = np.flatnonzero(~inside)
            has_odd = np.diff(np.cumsum(odd)[blanks], prepend=0) > 0
            starts, ends = np.append(0, blanks[:-1] + 1)[has_odd], blanks[has_odd]
            among = np.zeros(len(chars), np.int8)
            among[starts], among[ends] = 1, -1
            among = np.cumsum(among, dtype=np.int8).view(bool)
            words = _strings(wide[among].view(np.uint8), np.append(0, np.cumsum(ends - starts)) * 4)
            among[starts] = False  # the first character stays and stands for the word
            inside &= ~among
            begins &= ~among
            begins[starts] = True
            chars = chars.copy()
            chars[starts] = _ODD[0]
        at = np.flatnonzero(begins)
        chars = chars[inside]
        values, which = self.pieces.find(_strings(chars, np.append(np.flatnonzero(begins[inside]), len(chars))))
        if strange:
            of_words, which_word = self.odd.find(words)
            which[np.searchsorted(at, starts)] = len(values) + which_word
            values = pa.concat_arrays([values, of_words])
        data, past = _taken(values, pa.array(which))
        cuts = np.cumsum([0] + [len(text) + 1 for text in texts])
        cuts = past[np.searchsorted(at, cuts)].tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _begins(chars: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pattern begins a piece in lower-cased text, which ends in three blanks:
    's|'t|'re|'ve|'m|'ll|'d|[letters]+|[number]|[others]+."""
    begins = kinds == _NUMBER
    begins[0] = True
    begins[1:] |= kinds[1:] != kinds[:-1]
    begins &= kinds != _BLANK
    at = np.flatnonzero(begins & (chars == ord("'")))
    one, two = chars[at + 1], chars[at + 2]
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    begins[at[short | long] + 1] = False
    after = np.concatenate([at[short] + 2, at[long] + 3])
    begins[after[kinds[after] == _LETTER]] = True
    return begins


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def _taken(values: pa.Array, which: pa.Array) -> tuple[bytes, np.ndarray]:
    """The chosen values one after the other, and the bounds of each."""
    chosen = values.take(which)
    _, bounds, data = chosen.buffers()
    bounds = np.frombuffer(bounds, np.int64)[chosen.offset:chosen.offset + len(chosen) + 1] if len(chosen) else np.zeros(1, np.int64)
    return (data.to_pybytes() if data is not None else b""), bounds


class Packer:
    """Packs examples that arrive one by one; ``put`` and ``finish`` give the pieces of finished sequences.

    An example is (key, ids, loss): its ids as bytes and how many of them, from
    the end, bear loss. A piece is (key, start, ids, total, sequence, offset).
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS, pending: int = 1024):
        self.limits = np.array([tokens, segments, loss], dtype=float)
        self.keep = pending
        self.examples: list = []
        self.demands = np.zeros((2, 0))  # tokens and loss-bearing tokens
        self.total = 0
        self.sequence = 0

    def put(self, examples: list) -> list:
        self._add(examples)
        out: list = []
        while len(self.examples) > self.keep or self.total > self.keep * self.limits[0]:
            out.extend(self._fill(self.limits))
        return out

    def finish(self) -> list:
        out: list = []
        while self.examples:
            tokens = int(self.limits[0])
            if self.total < tokens:
                tokens = 1 << (self.total.bit_length() - 1)
            out.extend(self._fill(np.array([tokens, *self.limits[1:]], dtype=float)))
        return out

    def _add(self, examples: list) -> None:
        new = [[key, 0, memoryview(ids), len(ids) // 4, loss] for key, ids, loss in examples if ids]
        self.examples.extend(new)
        self.demands = np.concatenate([self.demands, np.array([(e[3], e[4]) for e in new], dtype=float).reshape(-1, 2).T], axis=1)
        self.total += sum(e[3] for e in new)

    def _fill(self, limits: np.ndarray) -> list:
        """One sequence. Every example demands one segment, so that segments end a sequence but never rank examples."""
        tokens, segments, loss = limits.tolist()
        room, offset, out, gone = [tokens, segments, loss], 0, [], []
        size, bearing = self.demands.copy()
        while room[0] > 0 and room[1] > 0:
            fits = (size <= room[0]) & (bearing <= room[2])
            rank = np.where(fits, size * (room[0] / tokens ** 2) + bearing * (room[2] / loss ** 2), -1.0)
            at = int(rank.argmax()) if len(rank) else 0
            if len(rank) and rank[at] >= 0:
                key, start, ids, total, _ = self.examples[at]
                n, n_loss = int(size[at]), int(bearing[at])
                out.append((key, start, ids, total, self.sequence, offset))
                gone.append(at)
            else:
                cut = self._cut(room, size, bearing)
                if cut is None:
                    break
                at, n, n_loss = cut
                key, start, ids, total, _ = self.examples[at]
                out.append((key, start, ids[:4 * n], total, self.sequence, offset))
                self.examples[at][1:3] = start + n, ids[4 * n:]
                self.examples[at][4] -= n_loss
                self.demands[:, at] -= (n, n_loss)
            offset += n
            room = [room[0] - n, room[1] - 1, room[2] - n_loss]
            size[at] = np.inf  # what is left of it goes to another sequence
        if gone:
            left = np.ones(len(self.examples), bool)
            left[gone] = False
            self.demands = self.demands[:, left]
            self.examples = [e for e, stays in zip(self.examples, left.tolist()) if stays]
        self.total -= offset
        self.sequence += 1
        return out

    @staticmethod
    def _cut(room: list, size: np.ndarray, bearing: np.ndarray) -> tuple[int, int, int] | None:
        """The largest pending example, how many of its tokens go, and how many of those bear loss."""
        open_ = np.where(np.isfinite(size), size, -1)
        at = int(open_.argmax()) if len(open_) else -1
        if at < 0 or open_[at] <= 0:
            return None
        free = int(size[at] - bearing[at])  # tokens without loss come first
        n = int(min(room[0], size[at], free + room[2]))
        return (at, n, max(0, n - free)) if n > 0 else None


_OUT = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                  ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("n_loss", pa.int64()),
                  ("ids", pa.binary())])


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", tokens: int = TOKENS,
                   segments: int = SEGMENTS, loss_tokens: int = TOKENS, end_id: int = END_ID,
                   with_ids: bool = True, prompt: str | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, unless ``with_ids`` is off, the ids (little-endian 32-bit).

    ``tokenizer`` is the path of a tokenizer file that every executor has. All
    tokens of a document bear loss. With ``prompt``, the name of a column, an
    example is the tokens of its prompt, without loss, then those of its text and
    the end token, with loss; ``n_loss`` follows ``offset`` then and tells how many
    tokens of the piece, its last ones, bear loss. A null prompt has no tokens.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
                       *([F.col(prompt).alias("prompt")] if prompt else []))
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        if state.get("tokenizer", ("",))[0] != tokenizer:
            state["tokenizer"] = (tokenizer, WordTokenizer(tokenizer))
        tokenize = state["tokenizer"][1].ids
        packer, first = Packer(tokens, segments, loss_tokens), TaskContext.get().partitionId() << 33

        def batch_of(pieces: list) -> pa.RecordBatch:
            keys, starts, ids, totals, sequences, offsets = zip(*pieces)
            keys, losses = zip(*keys)
            size = [len(x) // 4 for x in ids]
            # tokens with loss are the example's last
            n_loss = [max(0, min(n, s + n - (t - l))) for s, n, t, l in zip(starts, size, totals, losses)] if prompt else size
            return record_batch(_OUT, keys, starts, size, [zlib.crc32(x) for x in ids], totals, [first + s for s in sequences],
                                offsets, n_loss, [bytes(x) for x in ids] if with_ids else [None] * len(ids))

        for batch in batches:
            parts = rolling.text_slices(batch, "text", SLICE)
            if prompt:
                parts = (small for part in parts for small in rolling.text_slices(part, "prompt", SLICE))
            for part in parts:
                ids = tokenize(part.column("text"))
                heads = tokenize(part.column("prompt")) if prompt else [b""] * len(ids)
                pieces = packer.put([((k, len(own) // 4 + 1), head + own + end, len(own) // 4 + 1)
                                     for k, head, own in zip(part.column("key").to_pylist(), heads, ids)])
                if pieces:
                    yield batch_of(pieces)
        pieces = packer.finish()
        if pieces:
            yield batch_of(pieces)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    packed = rows.mapInArrow(pack, "key long, start long, length long, ids_crc32 long, doc_tokens long, "
                                   "sequence_id long, offset long, n_loss long, ids binary")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["n_loss"] * bool(prompt) + ["ids"] * with_ids
    return packed.select(F.col("key").alias(key), *names)
