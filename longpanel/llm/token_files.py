"""Token ids as flat unsigned integer files with 64-bit document offsets, written and read in parallel.

Documents are range partitioned and sorted by ``doc_id`` (NULL first; equal ids by a hash of the text). Each partition
writes one pair of files below the given folder, named by its attempt, so that a repeated or lost attempt cannot mix
with another:

* ``<name>.bin``: the ids of its documents one after another, little-endian, 2 bytes wide if the vocabulary allows,
  else 4; each document ends with the end id;
* ``<name>.idx``: the 8 bytes ``TOKENIX1``, the number of documents and the width of an id (both unsigned 64-bit), the
  offset in ids of every document in this partition and of their end (unsigned 64-bit), the document ids (signed
  64-bit) and a byte for each that is 1 where the id is NULL.

Partitions that finished are listed in the manifest, a Parquet table, with the number of documents and ids before them:
prefix sums over one row a partition. Local files are memory-mapped to be read; other stores are read whole, one
partition at a time.

NULL and empty texts hold the end id alone. An empty table gives an empty manifest. Repeated rows are written again.
Other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, islice
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import releasing
from .scratch import folder, partitions
from .words import batches

MAGIC = b"TOKENIX1"
MANIFEST = "part int, file string, width int, n_docs long, n_tokens long"
#: White space on both sides of a space: there a text cannot be cut at single spaces without changing its tokens.
_WHITE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = rf"{_WHITE} (?:{_WHITE}|\z)"
_SPACE = re.compile(r"\s")
#: Letters or digits, then marks that never join them in a token.
_MARKS = ".,;:!?|*$%&#)"
_MARKED = re.compile(r"(\S*[^\W_])([.,;:!?|*$%&#)]+)\Z")
#: Letters of which every pre-tokenizer says so.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: A newline that is not alone between non-spaces.
_EDGE = re.compile(r"\A\n|\n\Z|\s\n|\n\s")
#: Most pieces remembered that follow a space, that begin a text or line, and code points of the longest.
KEEP, KEEP_FIRST, _LONGEST = 400_000, 20_000, 48
_ID = attrgetter("id")
#: Bytes of text that are encoded together; a longer text stands alone.
BATCH = 6 << 20


class Known:
    """Pieces and their ids in flat arrays, looked up by a column at a time; the first ``room`` pieces are kept."""

    def __init__(self, room: int, kind: np.dtype) -> None:
        import pyarrow as pa

        self.room, self.kind = room, kind
        self.pieces, self.ids, self.size = pa.array([], pa.string()), np.empty(0, kind), np.empty(0, np.int32)

    def find(self, pieces) -> np.ndarray:
        """Place of each piece of an Arrow column, -1 for those that are not kept."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False)

    def at(self, places: np.ndarray) -> list[bytes]:
        end = np.cumsum(self.size, dtype=np.int64) * self.kind.itemsize
        raw, n = memoryview(self.ids.tobytes()), self.size.astype(np.int64) * self.kind.itemsize
        return [bytes(raw[x:y]) for x, y in zip((end - n)[places].tolist(), end[places].tolist())]

    def learn(self, pieces: list[str], ids: list[bytes]) -> None:
        import pyarrow as pa

        room = self.room - len(self.pieces)
        few = list(islice(((p, b) for p, b in zip(pieces, ids) if len(p) <= _LONGEST), room)) if room > 0 else []
        if few:
            self.pieces = pa.concat_arrays([self.pieces, pa.array([p for p, _ in few])])
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join([b for _, b in few]), self.kind)))
            self.size = np.concatenate((self.size, np.fromiter((len(b) for _, b in few), np.int32, len(few)) // np.int32(self.kind.itemsize)))


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file with a byte-level pre-tokenizer.

    That pre-tokenizer starts a new token at every space that a non-space follows, and at both sides of a single
    newline between non-spaces. So what stands between is encoded alone, many pieces in one string of lines, each
    different piece of a batch once, and remembered: the first that fit, which are mostly the frequent ones. Texts with
    runs of white space are encoded whole, as are pieces that do not fit these rules.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.newline = self.whole("\n")
        # a word of letters is one pre-token: the model can have it as it is, if nothing comes before the model
        pre = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        self.direct = self.tokenizer.normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.model = self.tokenizer.model
        self.first, self.later = Known(KEEP_FIRST, self.kind), Known(KEEP, self.kind)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes() if text else b""

    def _lines(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces without white space, each after ``lead``: the lines of a few long strings."""
        out: list[bytes] = []
        w = self.width
        for at in range(0, len(pieces), 2000):
            few = pieces[at:at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([lead + f"\n{lead}".join(few)], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(ids == np.frombuffer(self.newline, self.kind)[0]) * w if len(self.newline) == w else []
            if len(cut) == len(few) - 1:
                raw, cut = ids.tobytes(), cut.tolist()
                out += [raw[x:y] for x, y in zip([0, *(c + w for c in cut)], [*cut, len(raw)])]
            else:
                out += [self.whole(lead + p) for p in few]
        return out

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words of letters, each after ``lead``."""
        lead = lead.translate(_BYTES)
        ids, size, tokenize = [], [], self.model.tokenize
        for at in range(0, len(words), 5000):
            got = [tokenize(lead + (p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))) for p in words[at:at + 5000]]
            ids += map(_ID, chain.from_iterable(got))
            size += map(len, got)
        raw, end = np.array(ids, self.kind).tobytes(), np.cumsum(size, dtype=np.int64) * self.width
        return [raw[x:y] for x, y in zip([0, *end[:-1].tolist()], end.tolist())]

    def _plain(self, known: Known, pieces: list[str], new: list[str], lead: str) -> dict[str, bytes]:
        """Ids of different pieces that need no taking apart: ``pieces`` may be known, ``new`` are not; these are remembered."""
        import pyarrow as pa

        out = {}
        if pieces:
            place = known.find(pa.array(pieces, pa.string()))
            had = np.flatnonzero(place >= 0)
            out = dict(zip([pieces[i] for i in had.tolist()], known.at(place[had])))
            new = new + [pieces[i] for i in np.flatnonzero(place < 0).tolist()]
        words, lines, match = [], [], _LETTERS.fullmatch
        for p in new:
            if self.direct and (p.isascii() and p.isalpha() or match(p)):
                words.append(p)
            elif p and not _SPACE.search(p):
                lines.append(p)
        ids = self._words(words, lead) + self._lines(lines, lead)
        lines = words + lines
        known.learn(lines, ids)
        out.update(zip(lines, ids))
        if len(lines) < len(new):
            out.update((p, self.whole(lead + p)) for p in new if p not in out)
        return out

    def _pieces(self, heads: list[str], tails: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of different pieces that begin a text (``heads``) or follow a space (``tails``, which are not known)."""
        sides, unknown = [], []
        for side in (heads, tails):
            fresh = [p for p in side if p.isalpha()] if side is tails else []
            unknown.append(fresh)
            parts = {p for p in side if p.isalpha()} if side is heads else set()
            made = []  # (piece, its first part, marks at its end, lines after it)
            for p in side:
                if p.isalpha():
                    continue
                core = p.rstrip(_MARKS)
                if core.isalnum():
                    parts.add(core)
                    if len(core) < len(p):
                        made.append((p, core, p[len(core):], ()))
                    continue
                core, rest, mark = p, [], ""
                if "\n" in p and not _EDGE.search(p):
                    core, *rest = p.split("\n")
                if m := _MARKED.match(core):
                    core, mark = m[1], m[2]
                parts.add(core)
                if rest or mark:
                    made.append((p, core, mark, rest))
            sides.append((side, parts, made))
        begin = sides[0][1]
        for _, _, made in sides:
            for _, _, mark, rest in made:
                begin.add(mark)
                begin.update(rest)
        found = [self._plain(k, list(parts.difference(fresh)), fresh, lead)
                 for k, (_, parts, _), fresh, lead in zip((self.first, self.later), sides, unknown, ("", " "))]
        start, out = found[0], []
        for known, ids, (side, _, made) in zip((self.first, self.later), found, sides):
            whole, joined = dict(ids), []
            for p, core, mark, rest in made:
                b = ids[core] + start[mark] if mark else ids[core]
                if rest:
                    b += self.newline + self.newline.join([start[x] for x in rest])
                else:
                    joined.append((p, b))
                whole[p] = b
            new = [x for x in joined if x[0] not in ids]
            known.learn(*([list(x) for x in zip(*new)] if new else ([], [])))
            out.append([whole[p] for p in side])
        return out[0], out[1]

    def encode(self, texts, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts one after another, each closed by ``end``, and how many each text has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, _RUN)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        lists = pc.split_pattern(pc.if_else(odd, "", texts) if whole else texts, " ")
        cut = lists.offsets.to_numpy()
        cut = cut - cut[0]
        flat = lists.flatten()
        code = self.later.find(flat).copy()
        code[cut[:-1]] = 0  # the pieces that begin a text are looked at apart
        n, units, sizes = len(self.later.size), self.later.ids, self.later.size
        missing = np.flatnonzero(code < 0)
        coded = flat.take(pa.array(missing)).dictionary_encode()
        heads = flat.take(pa.array(cut[:-1])).to_pylist()
        different = list(dict.fromkeys(heads))
        first, later = self._pieces(different, coded.dictionary.to_pylist())
        first = dict(zip(different, first))
        begins = [first[p] for p in heads]
        for i in whole:
            begins[i] = self.whole(texts[i].as_py())
        indices = coded.indices.to_numpy()
        del lists, flat, coded, first, heads
        # units: what was known, the new later pieces, then the heads, then what closes a text
        more = [*later, *begins, end]
        units = np.concatenate((units, np.frombuffer(b"".join(more), self.kind)))
        size = np.concatenate((sizes, np.fromiter(map(len, more), np.int32, len(more)) // np.int32(self.width)))
        code[missing] = n + indices
        code[cut[:-1]] = n + len(later) + np.arange(len(texts))
        code = np.insert(code, cut[1:], len(size) - 1)
        # places in a batch fit 32 bits
        start = np.cumsum(size, dtype=np.int32) - size
        each = size[code]
        ends = np.cumsum(each, dtype=np.int32)
        base = start[code]
        base -= ends
        base += each
        # laid out by stretches: what a stretch needs stays small
        ids = np.empty(int(ends[-1]) if len(ends) else 0, self.kind)
        for x in range(0, len(code), 1 << 17):
            y = min(len(code), x + (1 << 17))
            a, z = int(ends[x] - each[x]), int(ends[y - 1])
            at = np.repeat(base[x:y], each[x:y])
            at += np.arange(a, z, dtype=np.int32)
            ids[a:z] = units[at]
        last = ends[cut[1:] + np.arange(len(texts))].astype(np.int64)
        return ids, np.diff(last, prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()  # one in a worker
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Write ``doc_id`` and ``text`` below ``path``; the manifest with ``base_docs`` and ``base_tokens``."""

    def save(frames: Iterator) -> Iterator:
        import pyarrow as pa

        gc.disable()  # what is remembered is much to look through, and nothing here makes cycles
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        store, root = _store(path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        out, keys, gone, sizes = None, [], [], []
        for frame in frames:
            for a, b in batches(frame.column("size").to_pylist(), BATCH):
                few = frame.slice(a, b - a)
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.bin")
                ids, size = enc.encode(few.column("text"), end)
                sizes.append(size.astype(np.uint64))
                gone.append(few.column("gone").to_numpy().astype(np.uint8))
                keys.append(few.column("doc_id").to_numpy().astype(np.int64))
                out.write(ids.tobytes())
        if out is None:
            return
        out.close()
        size = np.concatenate(sizes)
        offsets = np.concatenate((np.zeros(1, np.uint64), np.cumsum(size, dtype=np.uint64)))
        with store.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(MAGIC + np.array([len(size), enc.width], "<u8").tobytes() + offsets.astype("<u8").tobytes()
                    + np.concatenate(keys).astype("<i8").tobytes() + np.concatenate(gone).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([enc.width], pa.int32()), pa.array([len(size)], pa.int64()),
             pa.array([int(offsets[-1])], pa.int64())], ["part", "file", "width", "n_docs", "n_tokens"])

    tie = F.xxhash64("text")
    t = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().cast("int").alias("gone"),
                    F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    t = t.repartitionByRange(parts or partitions(docs), F.col("gone").desc(), "doc_id", tie)
    t = t.sortWithinPartitions(F.col("gone").desc(), "doc_id", tie)
    spark = docs.sparkSession
    t.mapInArrow(releasing(save), MANIFEST).write.parquet(f"{path}/finished")
    # one row a partition: the bases are their running sums
    done = spark.read.schema(MANIFEST).parquet(f"{path}/finished").orderBy("part").collect()
    docs_before = [0, *accumulate(r["n_docs"] for r in done)]
    tokens_before = [0, *accumulate(r["n_tokens"] for r in done)]
    rows = [(*r, d, n) for r, d, n in zip(done, docs_before, tokens_before)]
    spark.createDataFrame(rows, MANIFEST + ", base_docs long, base_tokens long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _mapped(store, root: str, name: str, kind) -> np.ndarray:
    if store.type_name == "local":
        return np.memmap(f"{root}/{name}", kind, "r")
    with store.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def read(manifest: DataFrame, path: str) -> DataFrame:
    """Per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, and ``part`` and ``row`` of its file."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(path)
        for frame in frames:
            for r in frame.itertuples():
                idx = _mapped(store, root, f"{r.file}.idx", np.uint8)
                if bytes(idx[:8]) != MAGIC:
                    raise ValueError(f"{r.file}.idx is not an index of token ids")
                n, width = (int(x) for x in np.frombuffer(idx[8:24].tobytes(), "<u8"))
                offsets = np.frombuffer(idx[24:32 + 8 * n], "<u8").astype(np.int64)
                keys = np.frombuffer(idx[32 + 8 * n:32 + 16 * n], "<i8")
                gone = np.frombuffer(idx[32 + 16 * n:], np.uint8)
                ids = _mapped(store, root, f"{r.file}.bin", f"<u{width}")
                for a in range(0, n, 5000):
                    b = min(n, a + 5000)
                    crc = [zlib.crc32(ids[offsets[i]:offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pd.DataFrame({
                        "doc_id": pd.array(keys[a:b], "Int64").copy() if not gone[a:b].any() else pd.array(
                            [None if g else int(k) for k, g in zip(keys[a:b], gone[a:b])], "Int64"),
                        "start": r.base_tokens + offsets[a:b], "n_tokens": offsets[a + 1:b + 1] - offsets[a:b],
                        "ids_crc32": np.array(crc, np.int64), "part": r.part, "row": np.arange(a, b)})

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInPandas(
        releasing(load), "doc_id long, start long, n_tokens long, ids_crc32 long, part int, row long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    path = path or folder(docs.sparkSession, "tokens")
    return read(write(docs, path, tokenizer, end_id), path)
