"""Byte-level BPE encoding and decoding; merges come from a segment tree over adjacent pair ranks.

A tokenizer file (JSON of the ``tokenizers`` library, byte-level BPE) gives the vocabulary, the
ranked merges and the added tokens. Added tokens are found first, anywhere in the text (leftmost,
then longest); the text between them is cut into words by the byte-level pattern, and each word's
UTF-8 bytes start as single symbols. A segment tree holds, for each symbol, the rank and place of
the pair that it makes with the next one; its root is the leftmost pair of lowest rank. That pair
is merged, three leaves change (the merged place, the place that goes, the place before), and each
change climbs as far as it alters a minimum, until the root holds no pair. A word of n bytes so
takes O(n log n) whatever it holds; a run of millions of blanks is one word, encoded whole. Words of
less than ``WIDEST`` bytes that are not known yet are merged together, one segment tree in each row
of a matrix: each turn reads all roots, merges one pair in every row that has one and updates the
three leaves' ancestors level by level.

Words repeat, so each worker remembers the ids of such words in two generations of about
``KEPT_WORDS`` words: when the newer one is full, the older one is given up, and what is still in
use moves over. Ids don't depend on it. Arrow batches are worked through in slices of about
``SLICE_BYTES``, so a worker holds the words and ids of few texts at a time.

Decoding joins the bytes of all ids and reads them as UTF-8, broken sequences as U+FFFD. Ids
without a token are left out, null ids too; added tokens stay. Null texts encode as empty ones, to
no ids; null id lists decode to the empty text. Rows are handled one by one: repeated, tied and
null doc_ids don't matter, and extra columns pass through.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from .common import table

KEPT_WORDS = 80_000
SLICE_BYTES = 1 << 20
WIDEST = 64  # leaves of the widest segment tree in a matrix
ROWS = 16_384  # words merged together
LONG_WORD = 4096  # symbols from which flat arrays replace lists (memory only)
NO_PAIR = (1 << 63) - 1
PLACE_BITS = 36
PLACE = (1 << PLACE_BITS) - 1
OUTSIDE = (1 << 16) - 1  # no symbol's id
NONE = np.int32((1 << 31) - 1)


def byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


SLOTS = 1 << 18  # of the hash table of pairs, for at most half as many pairs


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * 0x2545F4914F6CDD1D >> 40) & (SLOTS - 1)


@lru_cache(maxsize=1)
def newer_letters():
    """Letters and digits that ``regex`` knows and Python's own tables don't (yet): the ``tokenizers`` library may not either."""
    unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    found = regex.findall(r"[\p{L}\p{N}]+", unknown)
    spans = "".join(f"{run[0]}-{run[-1]}" for part in found for run in _consecutive(part))
    return re.compile(f"[{spans}]" if spans else r"(?!)")


def _consecutive(text: str) -> Iterator[str]:
    a = 0
    for b in range(1, len(text) + 1):
        if b == len(text) or ord(text[b]) != ord(text[b - 1]) + 1:
            yield text[a:b]
            a = b


def _latin(text: str) -> bool:
    """Whether all signs are below U+0100 (no newer letters then); faster than a search."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec:
    def __init__(self, spec: dict, pattern: str):
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not spec["normalizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        added = spec.get("added_tokens") or []
        odd += [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if not plain or odd or before.get("add_prefix_space") or spec.get("post_processor"):
            raise ValueError(f"not a plain byte-level BPE file: {odd}")
        vocab, signs = model["vocab"], byte_signs()
        self.byte_id = [vocab[s] for s in signs]
        self.byte_ids = np.array(self.byte_id, np.int64)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.rank[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        if len(self.rank) > SLOTS // 2 or max(vocab.values()) >= OUTSIDE:
            raise ValueError("too many merges or ids")
        self.made_ids = np.array(self.made, np.int64)
        self.pair_keys, self.pair_ranks = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int64)
        keys = np.array([a << 16 | b for a, b in self.rank], np.int64).reshape(-1)
        for key, slot, rank in zip(keys.tolist(), _slot(keys).tolist(), self.rank.values()):
            while self.pair_keys[slot] >= 0:
                slot = (slot + 1) & (SLOTS - 1)
            self.pair_keys[slot], self.pair_ranks[slot] = key, rank
        byte_of = {s: bytes([b]) for b, s in enumerate(signs)}
        self.bytes_of = {i: b"".join(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in added}
        self.added_bytes = {t["content"]: np.int32(t["id"]).tobytes() for t in added}
        longest_first = sorted(self.added_bytes, key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.words, self.newer = regex.compile(pattern), newer_letters()
        self.borders = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.kept: dict[str, bytes] = {}  # word -> ids as int32
        self.older: dict[str, bytes] = {}

    def merge(self, ids) -> list[int]:
        """Symbol ids of one word after all merges."""
        n = len(ids)
        if n < 2:
            return list(ids)
        rank, made = self.rank, self.made
        size = 1 << (n - 2).bit_length()
        if n < LONG_WORD:
            tree, after, before = [NO_PAIR] * (2 * size), list(range(1, n + 1)), list(range(-1, n - 1))
        else:
            tree, after, before = array("q", [NO_PAIR]) * (2 * size), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        for i in range(n - 1):
            r = rank.get((ids[i], ids[i + 1]))
            if r is not None:
                tree[size + i] = r << PLACE_BITS | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        while (top := tree[1]) != NO_PAIR:
            i = top & PLACE
            gone = after[i]
            ids[i] = made[top >> PLACE_BITS]
            last = after[i] = after[gone]
            first = before[i]
            ids[gone] = -1
            changes = [(gone, NO_PAIR), (i, NO_PAIR)]
            if last < n:
                before[last] = i
                r = rank.get((ids[i], ids[last]))
                if r is not None:
                    changes[1] = (i, r << PLACE_BITS | i)
            if first >= 0:
                r = rank.get((ids[first], ids[i]))
                changes.append((first, NO_PAIR if r is None else r << PLACE_BITS | first))
            for place, value in changes:
                k = size + place
                if k < 2 * size:
                    tree[k] = value
                    k >>= 1
                    while k:
                        a, b = tree[2 * k], tree[2 * k + 1]
                        low = a if a < b else b
                        if tree[k] == low:
                            break
                        tree[k] = low
                        k >>= 1
        return [x for x in ids if x >= 0]

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of words of less than ``WIDEST`` bytes, merged in matrices of segment trees."""
        out, size, leaves = [b""] * len(words), np.fromiter(map(len, words), np.int64, len(words)), 8
        narrower = 0
        while leaves <= WIDEST:
            members = np.flatnonzero((size >= narrower) & (size < leaves))
            for some in (members[at : at + ROWS] for at in range(0, len(members), ROWS)):
                flat = np.frombuffer(b"".join([words[k] for k in some.tolist()]), np.uint8)
                merged, kept = self._matrix(self.byte_ids[flat], size[some], leaves)
                data, ends = merged.astype(np.int32).tobytes(), [0, *(np.cumsum(kept) * 4).tolist()]
                for k, a, b in zip(some.tolist(), ends, ends[1:]):
                    out[k] = data[a:b]
            narrower, leaves = leaves, leaves * 2
        return out

    def _matrix(self, flat: np.ndarray, size: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols sit at places 1 to n of a row; place 0 and those after n are outside, so every place has neighbours."""
        rows, width, bits = len(size), leaves + 1, leaves.bit_length()
        place = np.arange(width)
        ids = np.full((rows, width), OUTSIDE, np.int64)
        ids[(place >= 1) & (place <= size[:, None])] = flat
        tree = np.full((rows, 2 * leaves), NONE, np.int32)
        tree[:, leaves:] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel(), bits, np.tile(place[:-1], rows)).reshape(rows, leaves)
        for half in (leaves >> k for k in range(1, leaves.bit_length())):
            np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2], out=tree[:, half : 2 * half])
        after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
        tree, ids, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        row = np.arange(rows)
        while True:
            top = tree[row * (2 * leaves) + 1]
            left = top != NONE
            row, top = row[left], top[left].astype(np.int64)
            if not len(row):
                break
            base, root = row * width, row * (2 * leaves)
            i = top & ((1 << bits) - 1)
            own = self.made_ids[top >> bits]
            gone = after[base + i]
            last, first = after[base + gone], before[base + i]
            ids[base + i], ids[base + gone] = own, -1
            after[base + i], before[base + last] = last, i
            tree[root + leaves + gone] = NONE
            tree[root + leaves + i] = self.ranks(own, ids[base + last], bits, i)
            tree[root + leaves + first] = self.ranks(ids[base + first], own, bits, first)
            for changed in (gone, i, first):
                k = (changed + leaves) >> 1
                while k[0]:  # all rows are at the same level
                    pair = root + 2 * k
                    tree[root + k] = np.minimum(tree[pair], tree[pair + 1])
                    k = k >> 1
        ids = ids.reshape(rows, width)
        stays = (ids >= 0) & (ids != OUTSIDE)
        return ids[stays], stays.sum(axis=1)

    def ranks(self, a: np.ndarray, b: np.ndarray, bits: int, place: np.ndarray) -> np.ndarray:
        """rank << bits | place of each pair, NONE for pairs that don't merge."""
        key = a << 16 | b
        slot = _slot(key)
        held = self.pair_keys[slot]
        out = np.where(held == key, self.pair_ranks[slot] << bits | place, NONE).astype(np.int32)
        todo = np.flatnonzero((held != key) & (held >= 0))
        slot = slot[todo]
        while len(todo):  # the next slot, until the pair or an empty one is met
            slot = (slot + 1) & (SLOTS - 1)
            held = self.pair_keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.pair_ranks[slot[hit]] << bits | place[todo[hit]]
            more = ~hit & (held >= 0)
            todo, slot = todo[more], slot[more]
        return out

    def cut(self, part: str) -> list[str]:
        """The words of a text without added tokens. Only if it holds a letter newer than Python does the library set the borders."""
        if _latin(part) or not self.newer.search(part):
            return self.words.findall(part)
        return [part[a:b] for _, (a, b) in self.borders.pre_tokenize_str(part)]

    def learn(self, words: list[str]) -> None:
        """Ids of words that no generation holds, into the newer one; long words are merged one by one."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [k for k, x in enumerate(raw) if len(x) < WIDEST]
        self.kept.update(zip([words[k] for k in short], self.merge_rows([raw[k] for k in short])))
        if len(short) < len(raw):
            for word, x in zip(words, raw):
                if len(x) >= WIDEST:
                    symbols = map(self.byte_id.__getitem__, x)
                    ids = self.merge(list(symbols) if len(x) < LONG_WORD else array("q", symbols))
                    self.kept[word] = np.array(ids, np.int32).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; words that several of them share are merged once."""
        cut = [self.apart.split(t) if self.apart else [t] for t in texts]
        found = [[self.cut(part) for part in parts[::2]] for parts in cut]
        if len(self.kept) >= KEPT_WORDS:
            self.older, self.kept = self.kept, {}
        wanted = set(itertools.chain.from_iterable(itertools.chain.from_iterable(found))).difference(self.kept)
        again = wanted.intersection(self.older)
        self.kept.update((w, self.older[w]) for w in again)
        self.learn(list(wanted.difference(again)))
        ids_of = self.kept.__getitem__
        out = []
        for parts, lists in zip(cut, found):
            ids = [b"".join(map(ids_of, words)) for words in lists]
            for k, special in enumerate(parts[1::2]):
                ids[k] += self.added_bytes[special]
            out.append(np.frombuffer(b"".join(ids), np.int32))
        for word in [w for w in wanted if len(w) >= WIDEST]:
            del self.kept[word]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        try:
            data = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            data = b"".join([self.bytes_of.get(i, b"") for i in ids])
        return data.decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a tokenizer file, made once in each worker."""
    import public_tokenizers

    return Codec(read_spec(path), public_tokenizers.PATTERN)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut where ``column`` passes ``SLICE_BYTES``; a longer value is a slice of its own."""
    for batch in batches:
        own, width = batch[column], 1
        if pa.types.is_list(own.type):
            width = 4
            sizes = pc.fill_null(pc.list_value_length(own), 0)
        else:
            sizes = pc.fill_null(pc.binary_length(own), 0)
        fill = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) * width // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(fill)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _with(df: DataFrame, source: str, made: dict[str, tuple[T.DataType, Callable]], path: str) -> DataFrame:
    """``df`` with new columns: (type, codec and values of ``source`` -> Arrow array; later ones see earlier ones)."""
    schema = T.StructType([f for f in df.schema if f.name not in made] + [T.StructField(n, t) for n, (t, _) in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in _slices(batches, source):
            columns = dict(zip(batch.schema.names, batch.columns))
            values = columns[source]
            for name, (_, make) in made.items():
                values = columns[name] = make(own, values)
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema.names)

    return df.mapInArrow(run, schema)


def _encoded(own: Codec, texts: pa.Array) -> pa.Array:
    lists = own.encode_all([t or "" for t in texts.to_pylist()])
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))


def _decoded(own: Codec, lists: pa.Array) -> pa.Array:
    ids = pc.fill_null(lists.values, -1).to_numpy(zero_copy_only=False)
    ends, known = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
    return pa.array([own.decode(ids[a:b].tolist() if k else ()) for a, b, k in zip(ends, ends[1:], known)], pa.string())


IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the array column ``ids_col``. Map only; ``vocabulary`` is the file's path, on every node."""
    return _with(docs, text_col, {ids_col: (IDS, _encoded)}, vocabulary or default_vocabulary())


def decode(coded: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``coded`` with the text column ``text_col`` made from the ids alone. Map only."""
    return _with(coded, ids_col, {text_col: (T.StringType(), _decoded)}, vocabulary or default_vocabulary())


def round_trip(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, and ``decoded``, made from the ids: both in one pass."""
    made = {"ids": (IDS, _encoded), "decoded": (T.StringType(), _decoded)}
    return _with(docs, text_col, made, vocabulary or default_vocabulary())


def query(spark, sf_dir: str) -> DataFrame:
    """op12: ids of every whole document and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
