"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A slice of texts is cut into words where no piece of the vocabulary can span the cut, and equal
words are encoded once. The words' symbols lie in one flat array. A round finds each word's minimum
pair rank by a segmented minimum and merges the leftmost occurrences of it in all words at once.
Where one of them makes a pair of equal or better rank, those after it in the word wait for a later
round, so that the result is the sequential one in all cases. The array is compacted, and words
without a pair left are set aside, whenever that halves it; until then links lead over the gaps, and
a round looks again only at blocks of symbols that were touched. So words of all lengths go the same
way, and a long one costs little more than its merges.

Characters outside the vocabulary become their UTF-8 bytes' pieces. Decoding follows the library:
control ids vanish, one leading word mark is taken off, and bytes that are not valid UTF-8 give
U+FFFD each.

Work is per row and in slices of bounded size; nothing is shuffled. The vocabulary (a few MB, fixed
by the model file) is read on the driver and broadcast, so executors need no local file.

Defined results: a null text is an empty one, with only the begin and end ids; null ids decode to an
empty text. Other columns are carried through; one that has an output's name is replaced. Ids are
packed as little-endian unsigned 32-bit integers in a binary column, or an array if so asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.text_arrays import give_back

MARK = "▁"
NONE = np.iinfo(np.int32).max
SLICE_BYTES = 1 << 20
BLOCK = 256
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass
class Vocabulary:
    """Tables of a BPE model; ids from ``size`` on stand for code points that have no piece."""

    size: int
    bos: int
    eos: int
    byte_ids: np.ndarray
    char_id: np.ndarray
    cuts: np.ndarray
    slots: np.ndarray
    slot_rank: np.ndarray
    slot_id: np.ndarray
    eager: np.ndarray
    surfaces: list[bytes]
    marked: np.ndarray
    kind: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules, training = proto.normalizer_spec, proto.trainer_spec
        if training.model_type != 2 or not training.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, a leading word mark and no other normalisation are supported")
        names, kind = [p.piece for p in proto.pieces], np.array([p.type for p in proto.pieces])
        if set(kind.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        score = np.array([p.score for p in proto.pieces])
        order = np.unique(-score)  # equal scores share a rank
        rank = np.searchsorted(order, -score).astype(np.int32)
        ids = {names[i]: i for i in np.flatnonzero(kind == NORMAL)}
        pairs: dict[tuple[int, int], int] = {}
        eager = np.zeros(len(names), bool)
        for name, i in ids.items():
            for k in range(1, len(name)):
                a, b = ids.get(name[:k]), ids.get(name[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
                    for part in (a, b):
                        eager[part] |= rank[i] <= rank[part]
        char_id = np.full(0x110000, -1, np.int32)
        cuts = np.ones((256, 256), bool)
        cuts[:, 0x80:0xC0] = False
        for name, i in ids.items():
            if len(name) == 1:
                char_id[ord(name)] = i
            raw = np.frombuffer(name.replace(MARK, " ").encode(), np.uint8)
            cuts[raw[:-1], raw[1:]] = False
        unknown = training.unk_surface.encode()
        surfaces = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else unknown if k == UNKNOWN else n.replace(MARK, " ").encode() for n, k in zip(names, kind, strict=True)]
        byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(kind == BYTE):
            byte_ids[surfaces[i][0]] = i
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        merged = np.array(list(pairs.values()), np.int32)
        slots, slot_of = _hash_table(keys)
        slot_rank, slot_id = np.full(len(slots), NONE, np.int32), np.full(len(slots), -1, np.int32)
        slot_rank[slot_of], slot_id[slot_of] = rank[merged], merged
        bos, eos = names.index("<s>"), names.index("</s>")
        return cls(len(names), bos, eos, byte_ids, char_id, cuts.ravel(), slots, slot_rank, slot_id, eager, surfaces, np.array([n.startswith(MARK) for n in names]) & (kind == NORMAL), kind)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NONE and -1 where there is none."""
        keys = (a.astype(np.int64) << 32) | b
        at = _slot(keys, len(self.slots))
        rank, found = np.full(len(keys), NONE, np.int32), np.full(len(keys), -1, np.int32)
        rest: np.ndarray | slice = slice(None)
        while True:
            held = self.slots[at]
            hit = held == keys
            if isinstance(rest, slice):
                rank[hit], found[hit] = self.slot_rank[at[hit]], self.slot_id[at[hit]]
                rest = np.flatnonzero(~hit & (held >= 0))
                at, keys = at[rest], keys[rest]
            else:
                rank[rest[hit]], found[rest[hit]] = self.slot_rank[at[hit]], self.slot_id[at[hit]]
                more = ~hit & (held >= 0)
                rest, at, keys = rest[more], at[more], keys[more]
            if not len(rest):
                return rank, found
            at = (at + 1) & (len(self.slots) - 1)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing at a load of an eighth at most: the keys by slot (-1: free), and each key's slot."""
    size = 1 << (8 * len(keys)).bit_length()
    slots, where = np.full(size, -1, np.int64), np.zeros(len(keys), np.int64)
    for i, (key, at) in enumerate(zip(keys.tolist(), _slot(keys, size).tolist(), strict=True)):
        while slots[at] >= 0:
            at = (at + 1) & (size - 1)
        slots[at], where[i] = key, at
    return slots, where


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _merge_rounds(v: Vocabulary, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges, word by word, and their number per word. Words have a symbol at least."""
    words = np.arange(len(lengths))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rank, new = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)
    if len(sym):
        rank[:-1], new[:-1] = v.look_up(sym[:-1], sym[1:])
        rank[np.cumsum(lengths) - 1] = NONE
    while len(sym):
        live, open_words = _rounds(v, sym, rank, new, lengths)
        left = np.add.reduceat(live, np.cumsum(lengths) - lengths, dtype=np.int64)
        is_open = np.repeat(open_words, lengths)
        shut = live & ~is_open
        done.append((words[~open_words], left[~open_words], sym[shut]))
        keep = live & is_open
        sym, rank, new, words, lengths = sym[keep], rank[keep], new[keep], words[open_words], left[open_words]
    order = np.concatenate([w for w, _, _ in done]) if done else np.zeros(0, np.int64)
    sizes = np.concatenate([n for _, n, _ in done]) if done else np.zeros(0, np.int64)
    flat = np.concatenate([s for _, _, s in done]) if done else np.zeros(0, np.int32)
    begins = np.cumsum(sizes) - sizes
    back = np.argsort(order)
    return flat[_ranges(begins[back], sizes[back])], sizes[back]


def _rounds(v: Vocabulary, sym: np.ndarray, rank: np.ndarray, new: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge in place until half of the symbols are gone or closed: which symbols live, which words are open.

    The segmented minimum of a word is taken over the minima of its blocks, and only blocks that a
    merge has touched are looked at again, so that a round over a long word costs little.
    """
    n = len(sym)
    ends = np.cumsum(lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[ends - lengths] = -1, -1
    per_word = -(-lengths // BLOCK)
    of_word = np.repeat(np.arange(len(lengths)), per_word)
    nth = np.arange(len(of_word)) - np.repeat(np.cumsum(per_word) - per_word, per_word)
    begins = (ends - lengths)[of_word] + nth * BLOCK
    size = np.diff(np.append(begins, n))
    block_of = np.repeat(np.arange(len(begins)), size)
    low = np.minimum.reduceat(rank, begins)
    live, open_words = np.ones(n, bool), np.ones(len(lengths), bool)
    blocks, gone, held = np.arange(len(begins)), 0, n
    while True:
        owner = of_word[blocks]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(low[blocks], first)
        if (best == NONE).any():
            shut = owner[first[best == NONE]]
            open_words[shut] = False
            held -= int(lengths[shut].sum())
            stays = open_words[owner]
            blocks, owner, best = blocks[stays], owner[stays], best[best != NONE]
        if not len(blocks) or 2 * held <= n or 2 * gone >= n:
            return live, open_words
        number = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))
        hit = low[blocks] == best[number]
        some = blocks[hit]
        at = _ranges(begins[some], size[some])
        wanted = np.repeat(best[number[hit]], size[some])
        at = at[rank[at] == wanted]
        word = of_word[block_of[at]]
        # Of adjacent occurrences every other one merges, from the left.
        jump = np.ones(len(at), bool)
        jump[1:] = at[1:] != after[at[:-1]]
        index = np.arange(len(at))
        at = at[(index - np.maximum.accumulate(np.where(jump, index, 0))) % 2 == 0]
        at = _in_turn(v, sym, rank, new, before, after, at, of_word[block_of[at]])
        gone += len(at)
        right = after[at]
        sym[at], live[right], rank[right] = new[at], False, NONE
        after[at] = after[right]
        inner = at[after[at] >= 0]
        before[after[inner]] = inner
        rank[at] = NONE
        left = before[at]
        left = left[left >= 0]
        fresh = np.concatenate([left, inner])
        rank[fresh], new[fresh] = v.look_up(sym[fresh], sym[after[fresh]])
        touched = np.unique(block_of[np.concatenate([at, right, left])])
        cells = _ranges(begins[touched], size[touched])
        low[touched] = np.minimum.reduceat(rank[cells], np.cumsum(size[touched]) - size[touched])


def _in_turn(v: Vocabulary, sym: np.ndarray, rank: np.ndarray, new: np.ndarray, before: np.ndarray, after: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The occurrences that may merge at once: in each word, those up to the first that makes a pair of equal or better rank."""
    risky = np.flatnonzero(v.eager[new[at]])
    if not len(risky):
        return at
    here = at[risky]
    piece, right, left = new[here], after[after[here]], before[here]
    # The symbol on the left is a merged one if the occurrence before ends there.
    earlier = np.maximum(risky - 1, 0)
    joined = (risky > 0) & (after[at[earlier]] == left)
    left_sym = np.where(joined, new[at[earlier]], sym[left])
    pairs = np.minimum(
        np.where(left >= 0, v.look_up(left_sym, piece)[0], NONE),
        np.where(right >= 0, v.look_up(piece, sym[right])[0], NONE),
    )
    stops = risky[pairs <= rank[here]]
    last = np.full(int(word[-1]) + 1, len(at))
    np.minimum.at(last, word[stops], stops)
    return at[np.arange(len(at)) <= last[word]]


def _bytes_for_unknown(v: Vocabulary, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the byte pieces of code points that have no piece in their place."""
    strange = np.flatnonzero(sym >= v.size)
    if not len(strange):
        return sym, lengths
    raw = [chr(c).encode() for c in (sym[strange] - v.size).tolist()]
    counts = np.ones(len(sym), np.int64)
    counts[strange] = [len(r) for r in raw]
    out = np.repeat(sym, counts)
    begins = np.cumsum(counts) - counts
    out[_ranges(begins[strange], counts[strange])] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    word_begins = np.cumsum(lengths) - lengths
    return out, np.add.reduceat(counts, word_begins)


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array without nulls, from its first row on."""
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def encode_texts(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids, with begin and end, and the number of them per text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    prefixed = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    raw, offsets = _buffers(pc.replace_substring(prefixed, MARK, " "))
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw):
        cut[1:-1] = v.cuts[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
    cut[offsets] = True
    begins = np.flatnonzero(cut)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(raw)]).dictionary_encode() if len(raw) else None
    if words is None:
        return np.tile(np.array([v.bos, v.eos], np.int32), len(texts)), np.full(len(texts), 2)
    distinct, at = _buffers(words.dictionary)
    points = np.frombuffer(distinct.tobytes().decode().replace(" ", MARK).encode("utf-32-le"), np.uint32)
    lengths = np.add.reduceat((distinct & 0xC0) != 0x80, at[:-1], dtype=np.int64)
    sym = v.char_id[points]
    sym = np.where(sym < 0, v.size + points.astype(np.int32), sym)
    ids, sizes = _bytes_for_unknown(v, *_merge_rounds(v, sym, lengths))
    # The begin and end ids are two further words around the words of each text.
    table = np.concatenate([ids, np.array([v.bos, v.eos], np.int32)])
    sizes = np.concatenate([sizes, [1, 1]])
    starts = np.cumsum(sizes) - sizes
    index = words.indices.to_numpy(zero_copy_only=False)
    first_word = np.searchsorted(begins, offsets)
    n_words = np.diff(first_word)
    sequence = np.empty(len(index) + 2 * len(texts), np.int64)
    opens = first_word[:-1] + 2 * np.arange(len(texts))
    sequence[opens], sequence[opens + n_words + 1] = len(sizes) - 2, len(sizes) - 1
    sequence[_ranges(opens + 1, n_words)] = index
    counts = sizes[sequence]
    return table[_ranges(starts[sequence], counts)], np.add.reduceat(counts, opens)


def _decode_with_errors(v: Vocabulary, ids: list[int]) -> bytes:
    """The library's rule for byte pieces that are not valid UTF-8: each bad byte gives U+FFFD."""
    out, run, blank = b"", b"", True
    for i in [*ids, -1]:
        if i >= 0 and v.kind[i] == BYTE:
            run += v.surfaces[i]
            continue
        while run:
            size = next((n for n in (1, 2, 3, 4) if _is_one_char(run[:n])), 0)
            out, run = out + (run[:size] if size else "�".encode()), run[size or 1 :]
        if i >= 0:
            blank = blank and not out
            piece = v.surfaces[i]
            cut = blank and bool(v.marked[i])
            out += piece[1:] if cut else piece
            blank = blank and not cut
    return out


def _is_one_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of the ids; ``counts`` is the number of ids per text."""
    surfaces = pa.array(v.surfaces, pa.large_binary())
    raw, at = _buffers(surfaces.take(pa.array(ids)))
    ends = np.cumsum(counts)
    begins = ends - counts
    # One leading word mark goes from the first id that is no control id.
    shown = np.flatnonzero(v.kind[ids] != CONTROL)
    first = shown[np.minimum(np.searchsorted(shown, begins), max(0, len(shown) - 1))] if len(shown) else np.zeros(len(counts), np.int64)
    strip = (first >= begins) & (first < ends) & v.marked[ids[first]] if len(ids) else np.zeros(len(counts), bool)
    offsets = np.concatenate([[0], at[ends]]).astype(np.int64)
    keep = np.ones(len(raw), bool)
    keep[at[begins[strip]]] = False
    body = raw[keep]
    offsets[1:] -= np.cumsum(strip)
    # Between byte pieces a control id parts what would else be one character.
    inner = v.kind[ids] == CONTROL
    inner[begins[counts > 0]] = inner[ends[counts > 0] - 1] = False
    odd = set(np.searchsorted(ends, np.flatnonzero(inner), side="right").tolist())
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    try:
        body.tobytes().decode()
        if not odd:
            return out.cast(pa.large_string())
    except UnicodeDecodeError:
        pass
    texts = out.to_pylist()
    for k, raw_text in enumerate(texts):
        try:
            if k not in odd:
                raw_text.decode()
                continue
        except UnicodeDecodeError:
            pass
        texts[k] = _decode_with_errors(v, ids[begins[k] : ends[k]].tolist())
    return pa.array([t.decode() for t in texts], pa.large_string())


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in order, in slices of about SLICE_BYTES; a longer row is a slice of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _with(batch: pa.RecordBatch, fields: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c) if c != name else values for c in fields], names=fields)


def _byte_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def vocabulary(df: DataFrame, path: str) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, model: Broadcast, text: str = "text", out: str = "ids", packed: bool = True) -> DataFrame:
    """``df`` with the ids of ``text``: packed, or an array of integers."""
    schema = _schema(df, out, T.BinaryType() if packed else T.ArrayType(T.IntegerType()))
    fields = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = model.value
        for batch in batches:
            for part in _slices(batch, _byte_sizes(batch.column(text))):
                ids, counts = encode_texts(v, part.column(text))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                if packed:
                    values = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))])
                else:
                    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
                yield _with(part, fields, out, values)
        give_back()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: Broadcast, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of packed or array ``ids``."""
    schema = _schema(df, out, T.StringType())
    fields = schema.fieldNames()
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = model.value
        for batch in batches:
            column = batch.column(ids)
            sizes = _byte_sizes(column) if packed else 4 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for part in _slices(batch, sizes):
                column = part.column(ids)
                if packed:
                    raw, at = _buffers(pc.fill_null(column, b""))
                    flat, counts = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), np.diff(at) // 4
                else:
                    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)
                    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield _with(part, fields, out, decode_ids(v, flat, counts).cast(pa.string()))
        give_back()

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, model: Broadcast, text: str = "text", ids: str = "ids", out: str = "decoded", keep_text: bool = True) -> DataFrame:
    """``df`` with the packed ids of ``text`` and what they decode to, both made in one pass by one worker."""
    columns = df if keep_text else df.drop(text)
    schema = T.StructType([f for f in columns.schema.fields if f.name not in (ids, out)] + [T.StructField(ids, T.BinaryType()), T.StructField(out, T.StringType())])
    fields = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = model.value
        for batch in batches:
            for part in _slices(batch, _byte_sizes(batch.column(text))):
                flat, counts = encode_texts(v, part.column(text))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                made = {
                    ids: pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends * 4), pa.py_buffer(flat.astype("<u4"))]),
                    out: decode_ids(v, flat.astype(np.int64), counts).cast(pa.string()),
                }
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in fields], names=fields)
        give_back()

    return df.mapInArrow(run, schema)
