"""Lexical retrieval packing of documents into fixed windows (operator 1).

Documents are tokenised once. Shards are ranges of a lexical key (two minima of hashed token
ids, then the id), so that documents with common words meet in one shard and no key, however
hot, overfills one; a range of more than ``shard_tokens`` ids is cut into runs of at most that and
at least half of it. Each shard has one BM25 inverted index over its token ids, whose document
frequencies come from all documents (one entry a vocabulary id, a fixed bound). A seed document
opens a window; the index scores all unused documents of the shard by all of the seed's terms, and
the best fill the window greedily; the document that overflows is cut and seeds the next window.
What is left at a range's end is dealt into windows of powers of two, which need no padding.

Edge cases: a null or empty text is its end id alone; a document longer than the window spans
several, and one longer than a shard is a shard; equal scores go by place in the shard; repeated rows
are packed one by one; an empty table gives an empty result; other columns are ignored; null ids sort
first.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import batch, materialise, release, strings, text_or_empty, tidy, worker_cache

#: Texts for which lower-casing and the pattern below do what the tokenizer would: no letters beyond Latin, no marks that combine, no odd digits.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7f\xa0-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\u012f\u0132-\u0148\u014a-\u017e\u2010-\u2027\u2030-\u205e\u20ac]*").fullmatch
#: The normaliser and the pattern of tokenizers whose pre-tokens are found word by word.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: All pre-tokens of a word but its runs of letters; a no-break space is no pre-token, but parts them.
_NO_LETTERS = r"('(?:s|t|re|ve|m|ll|d)|[0-9]|\x{a0}|[^a-z0-9\x{a0}\x{b5}\x{df}-\x{f6}\x{f8}-\x{17e}]+)"
#: What such tokenizers do to a pre-token before their model sees it.
_SPELLED = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SPACE = "\u0120"  # a blank, as the byte level spells it
K1, B = 1.2, 0.75


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def ends_of(lists: pa.Array) -> np.ndarray:
    """Where each list ends in the lists' values."""
    return np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)


def joined(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Each run of ``values`` (binary, without nulls) up to the next of ``ends`` as one value."""
    at = np.frombuffer(values.buffers()[1], np.int32)[np.append(0, ends) + values.offset]
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), values.buffers()[2]])


class PieceIds(dict):
    """Pre-token -> its ids as bytes, by the tokenizer's model. A batch of texts is cut at white space, which no pre-token
    crosses, and each distinct word of it is cut and looked up once. The table starts anew with the last batch's pre-tokens at
    ``room`` entries or as many characters of long ones. Other tokenizers than those that cut texts in this way get whole texts."""

    def __init__(self, path: str, room: int = 300_000, closing: str = "</w>"):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.room, self.long = Tokenizer.from_file(path), room, 0
        made = json.loads(self.tokenizer.to_str())
        first, *rest = [*(made["pre_tokenizer"] or {}).get("pretokenizers", []), {}]
        self.in_pieces = made["normalizer"] == _NORMALISER and first.get("pattern") == _PATTERN and bool(first.get("invert")) and rest == [_SPELLED, {}] and made["model"].get("end_of_word_suffix") == closing
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.model, self.byte_level = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, pieces: list[str]) -> None:
        tokenize, code = self.model.tokenize, self.kind.char
        odd = [p for p in pieces if not p.isascii() or "\x7f" in p]
        spelled = dict(zip(odd, self.byte_level.pre_tokenize_str(" ".join(odd))[0][0].split(SPACE), strict=True)) if odd else {}
        for p in pieces:
            ids = [t.id for t in tokenize(spelled.get(p, p))]
            self[p] = struct.pack(f"<{len(ids)}{code}", *ids)
        self.long += sum(len(p) for p in pieces if len(p) > 40)

    def forget(self, but: list[str]) -> None:
        """Start anew with the pre-tokens of ``but`` that are not long."""
        kept = [(p, self[p]) for p in but if len(p) <= 40 and p in self]
        self.clear()
        self.long = 0
        if 2 * len(kept) <= self.room:
            self.update(kept)

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()), end_id).to_pylist()

    def encode_column(self, column: pa.Array, end_id: int) -> pa.Array:
        """Ids of each text and the end id; texts that are not plain go to the tokenizer whole."""
        end, texts = np.array([end_id], self.kind).tobytes(), strings(column)
        plain = np.array([self.in_pieces and _PLAIN(t) is not None and not any(x in t for x in self.special) for t in texts], bool)
        if not plain.all() or column.null_count:
            column = pa.array([t if p else "" for t, p in zip(texts, plain.tolist(), strict=True)], pa.string())
        lists = pc.ascii_split_whitespace(column)
        words = lists.flatten().dictionary_encode()
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.dictionary), _NO_LETTERS, r" \1 "))
        pieces = cut.flatten().dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary), "\n")[0].as_py().split("\n")
        if len(self) > self.room or self.long > self.room:
            self.forget(names)
        self.update({"": b"", "\xa0": b""})
        self.learn([p for p in names if p not in self])
        known = joined(binary([*map(self.__getitem__, names)]).take(pieces.indices), ends_of(cut))
        # after the distinct words: the end id, then texts that went whole
        entries = pa.concat_arrays([known, binary([end, *(self.whole(t) + end for t, p in zip(texts, plain.tolist(), strict=True) if not p)])])
        last = np.where(plain, len(known), len(known) + np.cumsum(~plain))
        ends = ends_of(lists)
        chosen = np.insert(words.indices.to_numpy().astype(np.int64), ends, last)
        return joined(entries.take(pa.array(chosen)), ends + np.arange(1, len(ends) + 1))


def piece_ids(path: str) -> PieceIds:
    return worker_cache("packing", path, lambda: PieceIds(path))


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, batch_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n, ids (little-endian, 2 or 4 bytes each), low and next: the two least hashes of its distinct ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("low", pa.int64()), ("next", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_ids(tokenizer_path)
        none = own.tokenizer.get_vocab_size()
        order = np.random.default_rng(7).permutation(none).astype(np.int32)
        for whole in batches:
            reach = np.cumsum(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + batch_bytes, "right")))
                b = whole.slice(at, to - at)
                ids = own.encode_column(b.column(1), end_id)
                ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // own.kind.itemsize
                places = order[np.frombuffer(ids.buffers()[2], own.kind, ends[-1])]
                low = np.minimum.reduceat(places, ends[:-1])  # each has an id at least
                places[places == np.repeat(low, np.diff(ends))] = none
                yield batch(schema, b.column(0), np.diff(ends).astype(np.int64), ids, low.astype(np.int64), np.minimum.reduceat(places, ends[:-1]).astype(np.int64))
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(tidy(encode), "doc_id long, n long, ids binary, low long, next long")


def document_frequencies(tokens: DataFrame, kind: np.dtype) -> DataFrame:
    """(term, df) over all documents; terms -1 and -2 hold the numbers of documents and tokens."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # of the pre-tokens that this worker has learnt
        df, docs, total = np.zeros(1 << 16, np.int64), 0, 0
        for b in batches:
            for x in b.column(0):
                ids = np.frombuffer(x.as_py(), kind)
                if (most := int(ids.max(initial=0))) >= len(df):
                    df = np.append(df, np.zeros(most + 1 - len(df), np.int64))
                df[ids] += 1  # once for an id, however often it is there
                docs, total = docs + 1, total + len(ids)
        at = np.flatnonzero(df)
        yield batch(schema, np.append(at, [-1, -2]), np.append(df[at], [docs, total]))

    return tokens.select("ids").mapInArrow(tidy(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Index:
    """BM25 inverted index of a shard. Terms in an eighth of its documents or more have a row of all weights instead of a list."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, idf: np.ndarray, mean: float):
        n, terms = len(ends) - 1, len(idf)
        wide = np.uint32 if n * terms < 1 << 32 else np.int64
        key = np.repeat(np.arange(n, dtype=wide) * wide(terms), np.diff(ends))
        key += flat.astype(wide, copy=False)  # in place, as are the next steps: a shard has millions of ids
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        tf = np.diff(np.append(at, len(key))).astype(np.float32)
        key = key[at]
        del at
        doc = (key // terms).astype(np.int32)
        key %= terms
        self.terms = term = key.astype(np.int32)
        del key
        self.ends = np.searchsorted(doc, np.arange(n + 1))
        long = np.diff(ends).astype(np.float32) / np.float32(mean)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * long[doc]))).astype(np.float32)
        order = np.argsort(term * np.int64(max(1, n)) + doc)  # no two are equal
        self.doc, self.weight = doc[order], weight[order]
        self.begins = np.append(0, np.cumsum(np.bincount(term, minlength=terms)))
        self.place = np.arange(n)  # documents still held, in order
        self.rows: dict[int, np.ndarray] = {}
        for t in np.flatnonzero(8 * np.diff(self.begins) >= max(n, 64)).tolist():
            i, j = self.begins[t], self.begins[t + 1]
            self.rows[t] = np.zeros(n, np.float32)
            self.rows[t][self.doc[i:j]] = self.weight[i:j]

    def drop_used(self, unused: np.ndarray) -> None:
        alive = unused[self.place]
        local = np.cumsum(alive, dtype=np.int32) - 1
        kept = alive[self.doc]
        self.begins = np.append(0, np.cumsum(kept))[self.begins]
        self.doc, self.weight, self.place = local[self.doc[kept]], self.weight[kept], self.place[alive]
        for t, row in self.rows.items():
            self.rows[t] = row[alive]

    def scores(self, seed: int) -> np.ndarray:
        """Of the documents held, by all of the seed's terms."""
        scores, lists = np.zeros(len(self.place), np.float32), []
        own = self.terms[self.ends[seed] : self.ends[seed + 1]]
        for t, i, j in zip(own.tolist(), self.begins[own].tolist(), self.begins[own + 1].tolist(), strict=True):
            row = self.rows.get(t)
            if row is not None:
                scores += row
            elif j > i:
                lists.append(slice(i, j))
        if lists:
            scores += np.bincount(np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), len(scores))
        return scores

    def best(self, scores: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` of ``near`` with the best scores, best first; ties by place in the shard."""
        if len(near) > most:
            own = scores[near]
            least = np.partition(own, len(near) - most)[len(near) - most]
            above = near[own > least]
            near = np.sort(np.append(above, near[own == least][: most - len(above)]))
        return self.place[near[np.argsort(-scores[near], kind="stable")]]

    def neighbours(self, seed: int, unused: np.ndarray, most: int) -> np.ndarray:
        """The best ``most`` unused documents that share words with the seed, best first; ties by place in the shard."""
        scores = self.scores(seed)
        return self.best(scores, np.flatnonzero((scores > 0) & unused[self.place]), most)

    def nearest(self, seed: int, unused: np.ndarray, most: int, first: int = 64) -> Iterator[int]:
        """The same one by one; few fill a window, so those after the ``first`` are put in order only when asked for."""
        scores = self.scores(seed)
        near = np.flatnonzero((scores > 0) & unused[self.place])
        yield from self.best(scores, near, min(first, most)).tolist()
        yield from self.best(scores, near, most)[first:].tolist()


class Packer:
    """Windows of one shard. Rows out: doc, start, length, window, offset."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence, self.fill = window, first, 0
        self.rows: list[tuple[int, int, int, int, int]] = []

    def put(self, doc: int, size: int) -> bool:
        """Add a document; true if it was cut by the end of a window."""
        at, cut = 0, False
        while at < size:
            n = min(size - at, self.window - self.fill)
            self.rows.append((doc, at, n, self.sequence, self.fill))
            at, self.fill = at + n, self.fill + n
            if self.fill == self.window:
                self.sequence, self.fill, cut = self.sequence + 1, 0, at < size
        return cut

    def close(self, open_rows: list[tuple]) -> list[tuple]:
        """Deal the last, partly filled window out to windows of powers of two."""
        out, left, room = [], self.fill, 0
        fill = 0
        for doc, start, length, *_ in open_rows:
            while length:
                if not room:
                    room, fill = 1 << (left.bit_length() - 1), 0
                    left -= room
                n = min(length, room)
                out.append((doc, start, n, self.sequence, fill))
                start, length, room, fill = start + n, length - n, room - n, fill + n
                self.sequence += room == 0
        self.fill = 0
        return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, shard_tokens: int = 4_000_000, block_docs: int | None = None, most_shards: int = 100_000, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, 4 bytes each; unless not ``with_ids``).

    ``block_docs``, if given, bounds a shard's documents too."""
    spark = docs.sparkSession
    own = piece_ids(tokenizer_path)
    kind, terms = own.kind, own.tokenizer.get_vocab_size()
    del own
    release()  # the driver needs no more of the tokenizer
    tokens = materialise(tokenised(docs, tokenizer_path, end_id))
    stats = {r.term: r.df for r in document_frequencies(tokens, kind).collect()}  # at most one row a vocabulary id
    n_docs, total = stats.pop(-1, 0), stats.pop(-2, 0)
    idf = np.zeros(terms, np.float32)
    for t, n in stats.items():
        idf[t] = np.log1p((n_docs - n + 0.5) / (n + 0.5))
    shared = spark.sparkContext.broadcast(idf)
    mean = max(1.0, total / max(1, n_docs))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), *[("ids", pa.binary())] * with_ids])

    def fill(packer: Packer, flat: np.ndarray, ends: np.ndarray, base: int) -> Iterator[None]:
        """Pack a shard, whose documents count from ``base``; stops now and then for full windows to be taken."""
        sizes = np.diff(ends)
        index, unused = Index(flat, ends, shared.value, mean), np.ones(len(sizes), bool)
        n_unused, nearest, todo = len(sizes), iter(()), 0
        while n_unused:
            doc = next((d for d in nearest if unused[d]), -1)
            fresh = doc < 0
            if fresh:
                while not unused[todo]:
                    todo += 1
                doc = todo
            before = packer.sequence
            unused[doc] = False
            n_unused -= 1
            packer.put(base + doc, int(sizes[doc]))
            if packer.sequence != before or fresh:  # a new window, or no neighbours left: this document is the seed
                if 2 * n_unused < len(index.place):
                    index.drop_used(unused)
                nearest = index.nearest(doc, unused, window)  # a window has no room for more: each has an id at least
                if len(packer.rows) >= 4096:
                    yield

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # of the pre-tokens that this worker has learnt
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        open_docs: list[tuple] = []  # (doc_id, ids) of the window not yet full
        names: list[int | None] = []  # documents read and not yet packed
        held: list[bytes] = []

        def taken(rows: list[tuple], known) -> pa.RecordBatch:
            found = [known(r[0]) for r in rows]
            parts = [ids[s : s + n].astype("<u4").tobytes() for (_, ids), (_, s, n, *_) in zip(found, rows, strict=True)]
            return batch(schema, [x[0] for x in found], [r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(x) for x in parts], [len(x[1]) for x in found], [r[3] for r in rows], [r[4] for r in rows], *[parts] * with_ids)

        def flush(n: int, last: bool) -> Iterator[pa.RecordBatch]:
            """Pack the first ``n`` documents read."""
            nonlocal open_docs
            own, flat = names[:n], np.frombuffer(b"".join(held[:n]), kind)
            ends = np.append(0, np.cumsum([len(x) // kind.itemsize for x in held[:n]], dtype=np.int64))
            del names[:n], held[:n]
            base = len(open_docs)

            def known(d: int) -> tuple:
                return open_docs[d] if d < base else (own[d - base], flat[ends[d - base] : ends[d - base + 1]])

            for _ in fill(packer, flat, ends, base) if n else ():
                yield taken([r for r in packer.rows if r[3] < packer.sequence], known)
                packer.rows = [r for r in packer.rows if r[3] == packer.sequence]
            done, left = ([r for r in packer.rows if (r[3] < packer.sequence) == full] for full in (True, False))
            if last:
                done, left = done + packer.close(left), []
            yield taken(done, known)
            keep = sorted({r[0] for r in left})
            place = {d: i for i, d in enumerate(keep)}
            open_docs, packer.rows = [(known(d)[0], known(d)[1].copy()) for d in keep], [(place[r[0]], *r[1:]) for r in left]

        def reach(most: int) -> int:
            """The number of first documents that have ``most`` ids together at most; one at least."""
            sizes = np.cumsum([len(x) // kind.itemsize for x in held])
            return max(1, int(np.searchsorted(sizes, most, "right")))

        size = 0
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                names.append(doc_id)
                held.append(raw.as_py())
                size += len(held[-1]) // kind.itemsize
                if size >= 2 * shard_tokens or block_docs and len(held) >= block_docs:
                    yield from flush(reach(shard_tokens), False)
                    size = sum(map(len, held)) // kind.itemsize
        if size > shard_tokens:
            yield from flush(reach(size // 2), False)
            while sum(map(len, held)) > shard_tokens * kind.itemsize:
                yield from flush(reach(shard_tokens), False)
        yield from flush(len(held), True)

    shards = max(1, min(most_shards, -(-total // shard_tokens)))
    dealt = tokens.repartitionByRange(shards, "low", "next", "doc_id").sortWithinPartitions("low", "next", "doc_id", "n") if n_docs else tokens
    return dealt.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
