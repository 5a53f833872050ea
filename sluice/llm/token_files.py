"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of their id and sorted within, so the files in order of
name, and the rows in order within each, are the documents in ascending id (null first; rows
that repeat an id follow each other, in the order of the input's partitions). A row holds the
document's id, the number of ids before it in the files of its task, its number of ids and the
ids, end id included; a task may write several files. Readers may start at any stripe; a lookup by id skips files, stripes and row groups
by their statistics and Bloom filters.

Texts are encoded by the tokenizers library in pieces, cut where byte-level BPE's pre-tokenizer
always cuts, so the ids are those of the whole text; the ids of a piece that comes again are
taken from a bounded table. Words of Latin letters, with or without marks after them, hold pre-tokens
that are known without a look (the letters, and the marks), so these go straight to the library's
model. Definitions with another pre-tokenizer, or with a normalizer, are not
cut: then whole texts are encoded. Null and empty texts hold the end id alone. An empty table
gives files without rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm._shared import broadcast_if_small, tune

#: Characters encoded in one call, about; bytes of text looked at together; pieces whose ids are kept; and the end-of-document id of the contract.
PART, TEXT, KEPT, END_ID = 1 << 16, 8 << 20, 700_000, 2
#: Where byte-level BPE's pre-tokenizer always cuts: before a space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts that begin or end with white space, or hold some other than single spaces and line breaks: there the pattern has to look.
_ODD = "^[ \n]|[ \n]$|[ \n][ \n]|[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n") + "]"
#: Marks that the pre-tokenizer keeps together after letters: all of ASCII but the apostrophe, which may begin a contraction.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: Words of Latin letters (a line break may come first), then marks.
_LATIN = "^\n?[A-Za-zÀ-ÖØ-öø-ɏ]+[" + re.escape(_MARKS) + "]*$"
_loaded: dict[int, Encoder] = {}


def byte_symbols() -> list[str]:
    """Byte-level BPE's character for each byte: the byte's own where that is printable, else the next one from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]




def cuts_at_spaces(definition: str) -> bool:
    """Whether a tokenizer's definition is byte-level BPE that cuts before spaces, so that pieces between them are encoded on their own."""
    known = json.loads(definition)
    before, model = known.get("pre_tokenizer") or {}, known.get("model") or {}
    level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    plain = not known.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"])) for t in known.get("added_tokens") or [])
    return model.get("type") == "BPE" and level and plain and added


class Encoder:
    """The tokenizers library's encoding of texts, piece by piece, each distinct piece once while it is kept."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.cuts = cuts_at_spaces(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of text behind each id
        for token, i in vocabulary.items():
            self.widths[i] = len(token.encode()) if i in added else len(token)
        #: Whether words may go to the model as they are: the library's alphabet is the known one, and no added token can stand in a word.
        self.direct = self.cuts and not any(re.search(r"[A-Za-zÀ-ɏ]", t.content) and re.fullmatch(_LATIN, t.content) or set(t.content) <= set(_MARKS) for t in added.values())
        self.symbols = byte_symbols()
        spelled = "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("\n É~")) if self.direct else ""
        self.direct = self.direct and spelled == "".join(self.symbols[b] for b in "\n É~".encode())
        self._forget()

    def _forget(self) -> None:
        """No piece is known: ``ids`` holds those of known pieces, at ``begun`` and ``sizes`` many of each."""
        self.known, self.ids = pa.array([], pa.large_string()), np.zeros(0, "<i4")
        self.begun, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<i4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each text's)."""
        found = [x for k in range(0, len(texts), 64) for x in self._ids(texts[k : k + 64])]
        return np.concatenate([self.ids[:0], *found]), np.array([len(x) for x in found], np.int64)

    def _together(self, pieces: pa.Array, space: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces put end to end, as texts that are cut between any two: ``space`` stands before each."""
        words, upto = pieces.to_pylist(), np.cumsum(pc.binary_length(pieces).to_numpy() + len(space))
        ids, sizes = [self.ids[:0]], [self.sizes[:0]]
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(upto // PART)) + 1) if words else ():
            a, b = int(part[0]), int(part[-1]) + 1
            ids += self._ids([space + space.join(words[a:b])])
            ends = np.searchsorted(np.cumsum(self.widths[ids[-1]]), upto[a:b] - (upto[a - 1] if a else 0), "right")
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that match _LATIN."""
        model, table = self.tokenizer.model, dict(enumerate(self.symbols))
        model._resize_cache(0)  # hardly a word comes twice
        tokenize, space, line = model.tokenize, self.symbols[0x20], [t.id for t in model.tokenize(self.symbols[0x0A])]
        marks: dict[str, list[int]] = {"": []}
        ids, sizes = [], []
        for w in words:
            first = w[0] == "\n"
            stem = w.rstrip(_MARKS)
            tail = w[len(stem) :]
            if first:
                stem = stem[1:]
            if not stem.isascii():
                stem = stem.encode().decode("latin-1").translate(table)
            found = [t.id for t in tokenize(stem if first else space + stem)]
            if tail not in marks:
                marks[tail] = [t.id for t in tokenize(tail)]
            if first:
                found = line + found
            found += marks[tail]
            sizes.append(len(found))
            ids += found
        return np.array(ids, "<i4"), np.array(sizes, np.int64)

    def _learn(self, pieces: pa.Array) -> None:
        """Encode pieces that follow a space, which they are given without, or that begin with a line break."""
        line, loose = pc.starts_with(pieces, "\n"), pc.match_substring_regex(pieces, r"\s$|[^\x00-\x7F]$")
        ends = loose.to_numpy(zero_copy_only=False)
        ends[ends] = [x[-1].isspace() for x in pieces.filter(loose).to_pylist()]  # it ends a text and would join with what followed it
        line = line.to_numpy(zero_copy_only=False)
        word = pc.match_substring_regex(pieces, _LATIN).to_numpy(zero_copy_only=False) if self.direct else np.zeros(len(pieces), bool)
        flat, begun, sizes, n = [self.ids], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), len(self.ids)
        for own, encode in (
            (word, lambda x: self._words(x.to_pylist())),
            (~word & ~line & ~ends, lambda x: self._together(x, " ")),
            (~word & line & ~ends, lambda x: self._together(x, "")),
            (~word & ends, lambda x: self._alone([w if w[0] == "\n" else f" {w}" for w in x.to_pylist()])),
        ):
            ids, many = encode(pieces.filter(pa.array(own)))
            begun[own], sizes[own] = n + np.cumsum(many) - many, many
            flat.append(ids)
            n += len(ids)
        self.known, self.ids = pa.concat_arrays([self.known, pieces]), np.concatenate(flat)
        self.begun, self.sizes = np.append(self.begun, begun), np.append(self.sizes, sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, number of ids of each text) of an Arrow array of texts; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.cuts:
            return self._alone(texts.to_pylist())
        plain = pc.invert(pc.match_substring_regex(texts, _ODD))
        if pc.all(plain).as_py() is not False:
            # every piece but a text's first follows a space; those that begin a line keep the break
            return self._gather(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "))
        split = [x.replace("\n", " \n").split(" ") if easy else _CUT.split(x) for x, easy in zip(texts.to_pylist(), plain.to_pylist())]
        return self._gather(pa.array(split, pa.large_list(pa.large_string())))

    def _gather(self, split: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as lists of pieces, one at least each: those of the distinct pieces are put where they occur."""
        at = split.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = split.flatten().dictionary_encode()
        which, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_string())
        heads, of = np.unique(which[at[:-1]], return_inverse=True)
        which[at[:-1]] = len(pieces) + of
        used = np.bincount(which, minlength=len(pieces))[: len(pieces)] > 0
        others = pieces.filter(pa.array(used))
        if len(self.known) > KEPT:
            self._forget()
        place = pc.fill_null(pc.index_in(others, self.known), -1).to_numpy().astype(np.int64)
        new = place < 0
        place[new] = len(self.known) + np.arange(int(new.sum()))
        self._learn(others.filter(pa.array(new)))
        begun, sizes = (np.zeros(len(pieces), np.int64) for _ in range(2))
        begun[used], sizes[used] = self.begun[place], self.sizes[place]
        first_ids, first_sizes = self._alone(pieces.take(pa.array(heads)).to_pylist())
        sizes = np.append(sizes, first_sizes)
        begun = np.append(begun, len(self.ids) + np.cumsum(first_sizes) - first_sizes)
        many = sizes[which]
        upto = np.append(0, np.cumsum(many))
        return np.concatenate([self.ids, first_ids])[np.repeat(begun[which] - upto[:-1], many) + np.arange(upto[-1])], np.diff(upto[at])


def _encoder(definition: str) -> Encoder:
    key = hash(definition)
    if key not in _loaded:
        _loaded[key] = Encoder(definition)
    return _loaded[key]


def _blocks(batches):
    """Arrays (ids, texts) of about TEXT bytes of text from Arrow batches."""
    held, size = [], 0

    def block():
        return tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))

    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(upto // TEXT)) + 1):
            a, b = int(part[0]), int(part[-1])
            own = int(upto[b] - (upto[a - 1] if a else 0))
            if held and size + own > TEXT:
                yield block()
                held, size = [], 0
            held.append(batch.slice(a, len(part)))
            size += own
    if held:
        yield block()


def encode_ids(docs: DataFrame, tokenizer_file: str, id_col: str, text: str, end_id: int | None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of ``docs``' rows in their order; start counts from each partition's beginning."""
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()  # a megabyte or two, sent with the task: executors need no file

    def run(batches):
        encoder, start = _encoder(definition), 0
        for ids_of, texts in _blocks(batches):
            ids, n = encoder.encode(texts)
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(start + ends - n), pa.array(n), lists], names=["doc_id", "start", "n_tokens", "ids"])
            start += int(ends[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids array<int>")


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> None:
    """Encode every document and write its ids below ``path`` in ascending id order."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("turn"))
    ordered = rows.repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn")
    encoded = encode_ids(ordered, tokenizer_file, "doc_id", "text", end_id)
    encoded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(64 << 20)).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) over all files; start counts the ids of all documents before.

    Totals by writing task come from a narrow read; one small row a task is summed in their order.
    """
    place = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")  # the task that wrote the file
    rows = spark.read.orc(path).select("doc_id", "start", "n_tokens", "ids", place.alias("place"))
    totals = rows.groupBy("place").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("place", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(broadcast_if_small(bases), "place").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of a few documents; statistics and Bloom filters prune the rest before it is read."""
    return spark.read.orc(path).where(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``rows`` with ids replaced by ids_crc32: unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    kept = [c for c in rows.columns if c != "ids"]
    schema = rows.drop("ids").withColumn("ids_crc32", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            lists = batch.column(len(kept))
            at = lists.offsets.to_numpy()
            raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
            crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(crc, pa.int64())], names=[*kept, "ids_crc32"])

    return rows.select(*kept, "ids").mapInArrow(run, schema)
