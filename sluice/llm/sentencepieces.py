"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is indexed by a suffix array that reaches as far as the longest piece: its
pre-tokens are laid end to end, those that come again in the batch only once. Every piece of the
vocabulary is binary-searched in it; the range found is all its occurrences, each an edge from
where it starts to where it ends. The edges are sorted by position and relaxed from left to
right: every position keeps the last token of the best segmentation of what precedes it.

The model is a BPE model, so "best" is the segmentation its merges make. Two facts turn that
into a relaxation over edges: a prefix made of whole tokens of a text is segmented as the text
is, and a segmentation is the merges' own exactly if every token is what its own text merges to
and no neighbouring pair would be joined across its border. So of the edges that end at a
position exactly one joins validly to the token kept where it starts. Whether a pair does is
read off the model's merge trees (``PieceModel.borders``); nothing is merged to find it.

Text is indexed a block at a time, and pre-tokens longer than a window as overlapping windows
(``piece_model.in_windows``), so memory is bounded whatever a text holds. Nothing is kept from
batch to batch.

Characters without a piece are hard boundaries and stand as their UTF-8 bytes. Null and empty
texts have no ids and decode to the empty text. Decoding reads U+2581 as a space, also where
the text itself held that character. Repeated rows are encoded alike. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import free_name, tune
from sluice.llm.piece_model import SPACE, PieceModel, in_windows, load

#: Bytes of text in a batch, about.
TEXT = 4 << 20
_SEPARATOR = b"\xff"  # in no UTF-8 text, and above every byte of one
_WORD = 8  # bytes compared at once
#: Texts that hold spaces side by side, or U+2581 itself: there the model's pattern has to look.
_ODD = f"^ |  |{SPACE}"


def _utf8(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all words' bytes end to end, bytes of each)."""
    column = pa.array(words, pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(words) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8), np.diff(offsets)


class Matcher:
    """Matches a vocabulary in texts and relaxes the matches."""

    def __init__(self, model: PieceModel):
        self.model = model
        ids = [i for i in model.pieces if model.whole[i]]  # no other piece is ever a token
        spelled = [model.pieces[i].encode() for i in ids]
        self.piece_ids, self.lengths = np.array(ids, np.int64), np.array([len(p) for p in spelled], np.int64)
        self.depth = -(-int(self.lengths.max()) // _WORD)
        width = self.depth * _WORD
        read = lambda fill: np.frombuffer(b"".join(p.ljust(width, fill) for p in spelled), ">u8").astype(np.uint64).reshape(-1, self.depth)
        self.low, self.high = read(b"\0"), read(_SEPARATOR)
        self.letters = {p for p in model.ids if len(p) == 1}

    def edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece id) of every occurrence of every piece.

        The suffix array is refined eight bytes at a time. Pieces that end in those bytes have the
        range of suffixes between their least and greatest continuation; longer ones go on with
        the suffixes that share what they begin with, if any does.
        """
        n = len(text)
        raw = text + _SEPARATOR * (self.depth + 1) * _WORD
        words = np.ndarray((n + self.depth * _WORD,), ">u8", raw, 0, (1,)).astype(np.uint64)
        order = np.argsort(words[:n])
        values = words[order]
        key, group, open_ = np.arange(n), np.zeros(0, np.int64), np.arange(len(self.piece_ids))
        out = []
        for k in range(self.depth):
            low, high = np.searchsorted(values, self.low[open_, k]), np.searchsorted(values, self.high[open_, k], "right")
            if k:  # ``values`` are the distinct words here, ``key`` the suffixes' beginning and word
                low, high = (np.searchsorted(key, group * len(values) + x) for x in (low, high))
            many, ends = high - low, self.lengths[open_] <= (k + 1) * _WORD
            own = np.repeat(open_[ends], many[ends])
            start = order[_ranges(low[ends], many[ends])]
            out.append((start, start + self.lengths[own], self.piece_ids[own]))
            more = ~ends & (many > 0)
            if not more.any():
                break
            first, at, group = np.unique(low[more], return_index=True, return_inverse=True)
            sizes = many[more][at]
            shared = order[_ranges(first, sizes)]  # the suffixes that begin like a longer piece, by what they share
            values, rank = np.unique(words[shared + (k + 1) * _WORD], return_inverse=True)
            key = np.repeat(np.arange(len(first)), sizes) * len(values) + rank
            by = np.argsort(key)
            open_, order, key = open_[more], shared[by], key[by]
        return tuple(np.concatenate(x) for x in zip(*out))

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of tokens, whether the right one may follow the left one (below 0: a segment starts)."""
        out = left < 0
        at = np.flatnonzero(~out)
        keys, of = np.unique(left[at] * self.model.size + right[at], return_inverse=True)
        out[at] = self.model.borders(keys // self.model.size, keys % self.model.size)[of]
        return out

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, token, start) of all words' tokens, in order; starts in bytes. A token below 0 stands for a character's bytes.

        All words are relaxed together, position by position.
        """
        raw, sizes = _utf8(words)
        base = np.cumsum(sizes + 1) - (sizes + 1)  # a position more than bytes: where the separator stands
        of = np.repeat(np.arange(len(words)), sizes + 1)
        flat = np.full(len(of), _SEPARATOR[0], np.uint8)
        flat[np.arange(len(raw)) + np.repeat(np.arange(len(words)), sizes)] = raw
        text = flat.tobytes()
        start, end, token = self.edges(text)
        strange = set().union(*words) - self.letters
        bare = [(b + p, n) for w, b in zip(words, base.tolist()) if not strange.isdisjoint(w) for p, n in self._bare(w)] if strange else []
        if bare:  # characters without a piece are edges of their own, always taken
            at, n = np.array(bare, np.int64).T
            start, end, token = np.concatenate([start, at]), np.concatenate([end, at + n]), np.concatenate([token, -1 - n])
        place = end - base[of[start]]
        order = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")
        start, end, token, place = start[order], end[order], token[order], place[order]
        unseen = -100
        last, back = np.full(len(text) + 1, unseen), np.zeros(len(text) + 1, np.int64)
        last[base] = -1
        cuts = np.flatnonzero(np.diff(place)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
            s, e, t = start[a:b], end[a:b], token[a:b]
            take = t < 0
            ask = np.flatnonzero(~take & (last[s] != unseen))
            take[ask] = self.joins(last[s[ask]], t[ask])
            last[e[take]], back[e[take]] = t[take], s[take]
        begun, at = np.full(len(text) + 1, unseen), (base + sizes)[sizes > 0]
        while len(at):
            begun[back[at]] = last[at]
            at = back[at]
            at = at[last[at] != -1]
        at = np.flatnonzero(begun != unseen)
        return of[at], begun[at], at - base[of[at]]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens end to end, number of each one's)."""
        own, token, at = in_windows(words, self.tokens, lambda x: len(x.encode()))
        if (token < 0).any():  # spelled out in bytes
            raw, sizes = _utf8(words)
            width = np.where(token < 0, -1 - token, 1)
            place = np.repeat((np.cumsum(sizes) - sizes)[own] + at, width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
            own, token = np.repeat(own, width), np.repeat(token, width)
            token = np.where(token < 0, self.model.byte_ids[raw[place]], token)
        return token.astype("<i4"), np.bincount(own, minlength=len(words))

    def _bare(self, word: str):
        """(offset, bytes) of each character of a word that has no piece."""
        at = 0
        for c in word:
            n = len(c.encode())
            if c not in self.letters:
                yield at, n
            at += n


_matchers: dict[int, Matcher] = {}


def _matcher(content: bytes) -> Matcher:
    model = load(content)
    if id(model) not in _matchers:
        _matchers[id(model)] = Matcher(model)
    return _matchers[id(model)]


def _pretokens(texts: pa.Array, model: PieceModel) -> pa.Array:
    """The pre-tokens of each text, empty ones among them."""
    odd = pc.match_substring_regex(texts, _ODD)
    if not pc.any(odd).as_py():
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(SPACE, texts.type), pc.replace_substring(texts, " ", " " + SPACE), pa.scalar("", texts.type)))
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(marked, "\n", " \n "), "\t", " \t "), " ")
    return pa.array([model.pretokens(x) for x in texts.to_pylist()], pa.large_list(texts.type))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def encode_texts(texts: pa.Array, matcher: Matcher) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of a batch end to end, where each text's begin, and the end)."""
    split = _pretokens(texts, matcher.model)
    coded = split.flatten().dictionary_encode()
    which, at = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    ids, sizes = matcher.encode(coded.dictionary.to_pylist())
    many = sizes[which]
    upto = np.append(0, np.cumsum(many))
    return ids[_ranges((np.cumsum(sizes) - sizes)[which], many)], upto[at - at[0]]


def _batches(texts: pa.Array):
    """Consecutive parts of texts, each of about TEXT bytes; a longer text stands alone."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy())
    cuts = np.flatnonzero(np.diff(upto // TEXT)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        if a < b:
            yield a, texts.slice(a, b - a)


def encode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ids (array of int) and decoded, the ids' text; columns of those names are replaced."""
    tune(docs.sparkSession)
    with open(model_file, "rb") as f:
        content = f.read()  # half a megabyte, sent with the task: executors need no file
    held = [c for c in docs.columns if c != text and c.lower() not in ("ids", "decoded")]
    body = free_name(docs, "body")
    rows = docs.select(*[F.col(f"`{c}`") for c in held], F.col(f"`{text}`").cast("string").alias(body))
    schema = rows.drop(body).withColumn("ids", F.array(F.lit(0))).withColumn("decoded", F.lit("")).schema

    def run(batches):
        matcher = _matcher(content)
        for batch in batches:
            texts = batch.column(len(held)).cast(pa.large_string()).fill_null("")
            for a, part in _batches(texts):
                ids, at = encode_texts(part, matcher)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(i).slice(a, len(part)) for i in range(len(held))]
                yield pa.RecordBatch.from_arrays([*columns, lists, matcher.model.decode(ids, at)], names=[*held, "ids", "decoded"])

    return rows.mapInArrow(run, schema)
