"""A SentencePiece BPE model's vocabulary as lookup tables, its text rules, and its merges over ragged arrays.

Text is escaped (a space becomes U+2581) and one U+2581 is put before a text that is not
empty. Merges join adjacent symbols whose concatenation is a piece, highest score first,
leftmost on a tie; characters that are no piece stand as their UTF-8 bytes. No piece may hold
U+2581 after another character, nor a line break or tab: then a text's pre-tokens (runs of
U+2581 with what follows, and each line break or tab) are independent of each other, and equal
pre-tokens have equal tokens. The constructor checks this.

Two facts make merges local. A prefix made of whole tokens of a text is segmented as the text is.
And a segmentation is the merges' own exactly if every token is what its own text merges to and no
neighbouring pair would have been joined across its border. So a long pre-token is cut into
overlapping windows, which are segmented together; two windows that hold the same token at the
same place agree from there on.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"
PRETOKEN = re.compile(f"[\\n\\t]|{SPACE}+[^{SPACE}\\n\\t]*|[^{SPACE}\\n\\t]+")
#: Characters of a window, and of it shared with the next one; characters segmented at once.
WINDOW, OVERLAP, BLOCK = 256, 64, 1 << 18
_loaded: dict[int, PieceModel] = {}


class PieceModel:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.size = len(ids)
        self.pieces = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.pieces.items()}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        raw = {i: p.replace(SPACE, " ").encode() for i, p in self.pieces.items()} | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        spelled = [raw.get(i, b"") for i in ids]
        self._spelled, self._spelled_sizes = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled], np.int64)
        self._spelled_at = np.cumsum(self._spelled_sizes) - self._spelled_sizes
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or "\t" in p for p in self.ids):
            raise ValueError("a piece of this model crosses pre-tokens")
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.none = len(scores)
        self.rank = np.full(self.size + 1, self.none, np.int64)
        for i in plain:
            self.rank[i] = place[sp.get_score(i)]
        pairs = {self.ids[p[:k]] * self.size + self.ids[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        letters = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
        self._letters, self._letter_ids = (np.array(x, np.int64) for x in zip(*letters))
        #: When a piece comes to be: its rank; letters are there from the start.
        self.born = self.rank.copy()
        self.born[self._letter_ids] = -1
        #: Pieces that open no pair which would be merged before or with them: all their occurrences can be merged at once.
        self.calm = np.ones(self.size + 1, bool)
        for side in (self.pair_keys // self.size, self.pair_keys % self.size):
            self.calm[side[self.rank[self.pair_ids] <= self.born[side]]] = False
        words = [self.pieces[i] for i in plain]
        self._last = np.full((2, len(words)), -1)
        of, token, _ = self.merge(words, self._last)
        many = np.bincount(of, minlength=len(words))
        #: Whether a piece's own text merges to it, and the two symbols whose merge ends that.
        self.whole, self.left, self.right = np.zeros(self.size, bool), np.full(self.size, -1), np.full(self.size, -1)
        plain = np.array(plain)
        self.whole[plain] = (many == 1) & (token[np.cumsum(many) - many] == plain)
        own = plain[self.whole[plain] & (self.born[plain] >= 0)]
        row = {int(i): n for n, i in enumerate(plain)}
        self.left[own], self.right[own] = self._last[:, [row[int(i)] for i in own]]
        if (self.born[self.left[own]] > self.born[own]).any() or (self.born[self.right[own]] > self.born[own]).any():
            raise ValueError("a piece of this model is made of later ones")

    def pretokens(self, text: str) -> list[str]:
        return PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Letters' ids; -1 - code point for characters without a piece."""
        at = np.minimum(np.searchsorted(self._letters, codes), len(self._letters) - 1)
        return np.where(self._letters[at] == codes, self._letter_ids[at], -1 - codes)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols merges to; ``size``, whose rank is ``none``, where there is none."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], self.size)

    def merge(self, words: list[str], last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, token, start) of all words' tokens, in order; starts in characters.

        All words are held as one ragged array. In each round every word merges its lowest-rank pair,
        all words at once: all occurrences that don't overlap, from the left, where the pieces made are
        calm, and the leftmost otherwise. Words without a pair left leave. ``last`` receives the two
        symbols of each word's last merge.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols = self.symbols(codes)
        sizes = np.array([len(w) for w in words], np.int64)
        of = np.repeat(np.arange(len(words)), sizes)
        start = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        made = np.full(len(of), self.size)
        inner = np.flatnonzero(of[1:] == of[:-1])
        made[inner] = self.joined(symbols[inner], symbols[inner + 1])
        done = []
        while len(symbols):
            rank = self.rank[made]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            size = np.diff(np.append(first, len(of)))
            lowest = np.minimum.reduceat(rank, first)
            live = lowest < self.none
            if not live.all():
                gone = np.repeat(~live, size)
                done.append((of[gone], symbols[gone], start[gone]))
                symbols, of, start, made, rank = (x[~gone] for x in (symbols, of, start, made, rank))
                if not live.any():
                    break
                size, lowest = size[live], lowest[live]
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            owner = of[hit]
            new = np.append(True, owner[1:] != owner[:-1])
            word = np.cumsum(new) - 1
            calm = np.bincount(word, ~self.calm[made[hit]])[word] == 0
            run = new | np.append(True, np.diff(hit) > 1)
            inside = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[new | (calm & (inside % 2 == 0))]
            if last is not None:
                last[:, of[hit]] = symbols[hit], symbols[hit + 1]
            symbols[hit] = made[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # each merge before it took one away
            symbols, of, start, made = (x[keep] for x in (symbols, of, start, made))
            at = np.unique(np.concatenate([at, at[at > 0] - 1]))
            after = np.minimum(at + 1, len(of) - 1)
            pair = (after > at) & (of[after] == of[at])
            made[at] = np.where(pair, self.joined(symbols[at], symbols[after]), self.size)
        if not done:
            return (np.zeros(0, np.int64),) * 3
        of, symbols, start = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((start, of))
        return of[order], symbols[order], start[order]

    def borders(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of whole tokens, whether the merges of their joined text keep the border between them.

        Merges are undone on both sides of the border, the latest first. The symbols that stand at the
        border at a time would have been joined if their piece came before the next merge of either
        (on a tie the leftmost goes first).
        """
        good = np.ones(len(left), bool)
        live = np.arange(len(left))
        a, b = left.copy(), right.copy()
        until_a, until_b = (np.full(len(left), self.none) for _ in range(2))
        while len(live):
            rank = self.rank[self.joined(a, b)]
            crossed = (rank < until_a) & (rank <= until_b) & (rank < self.none)
            good[live[crossed]] = False
            undo_a = self.born[a] > self.born[b]
            until_a, until_b = np.where(undo_a, self.born[a], until_a), np.where(undo_a, until_b, self.born[b])
            rest = ~crossed & ((self.born[a] >= 0) | (self.born[b] >= 0))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            live, a, b, until_a, until_b = (x[rest] for x in (live, a, b, until_a, until_b))
        return good

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of ids end to end, whose texts begin at ``at``: pieces and bytes joined, U+2581 read as a space, the leading one dropped."""
        sizes = self._spelled_sizes[ids]
        upto = np.append(0, np.cumsum(sizes))
        raw = self._spelled[np.repeat(self._spelled_at[ids] - upto[:-1], sizes) + np.arange(int(upto[-1]))]
        begun, ended = upto[at[:-1]], upto[at[1:]]
        lead = (ended > begun) & (np.append(raw, 0)[begun] == 0x20)
        offsets = np.append(begun, upto[at[-1]])
        whole = pa.Array.from_buffers(pa.large_binary(), len(begun), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
        try:
            texts = whole.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no text
            texts = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())
        return pc.if_else(pa.array(lead), pc.utf8_slice_codeunits(texts, 1), texts).cast(pa.string())


def in_windows(words: list[str], tokens, measure=len, size: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, token, start) of all words' tokens, long words window by window; ``tokens`` gives the same of short ones.

    Windows are put together at a token that both of two neighbours hold. A word with neighbours that
    share none is cut again into windows twice as long. ``measure``: what starts count of a text.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    parts, word, base = words, np.arange(len(words)), np.zeros(len(words), np.int64)
    if len(words) and lengths.max() > size:
        parts, word, base = [], [], []
        for n, w in enumerate(words):
            at = 0
            for k in range(0, max(1, len(w) - overlap) if len(w) > size else 1, size - overlap):
                parts.append(w[k : k + size] if len(w) > size else w)
                word.append(n)
                base.append(at)
                if len(w) > size:
                    at += measure(w[k : k + size - overlap])
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    found = []
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // BLOCK)) + 1
    for first, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
        if first < stop:
            of, token, start = tokens(parts[first:stop])
            found.append(((of + first).astype(np.int32), token.astype(np.int32), start.astype(np.int32)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    part, token, at = (np.concatenate(x) for x in zip(*found))
    del found
    word, base = np.array(word, np.int32), np.array(base, np.int32)
    at += base[part]
    of = word[part]
    if len(parts) == len(words):
        return of, token, at
    far = np.iinfo(np.int32).max
    follows = np.append(False, word[1:] == word[:-1])
    leads = np.append(follows[1:], False)
    # tokens of the text that a window shares with the one before it, as seen from both
    mine = follows[part]
    theirs = leads[part] & (at >= np.append(base[1:], 0)[part])
    seen = np.concatenate([part[mine], part[theirs] + 1]), np.concatenate([at[mine], at[theirs]]), np.concatenate([token[mine], token[theirs]])
    order = np.lexsort(seen[::-1])
    seen = [x[order] for x in seen]
    both = np.flatnonzero(np.all([x[1:] == x[:-1] for x in seen], axis=0))
    cut = np.full(len(parts) + 1, far)
    np.minimum.at(cut, seen[0][both], seen[1][both])
    lost = np.unique(word[follows & (cut[:-1] == far)])
    begun = np.where(follows, cut[:-1], 0)
    ended = np.where(leads, cut[1:], far)
    keep = (at >= begun[part]) & (at < ended[part]) & ~np.isin(of, lost)
    of, token, at = of[keep], token[keep], at[keep]
    if len(lost):
        again = in_windows([words[n] for n in lost.tolist()], tokens, measure, size * 2, overlap * 2)
        of, token, at = np.concatenate([of, lost[again[0]]]), np.concatenate([token, again[1]]), np.concatenate([at, again[2]])
        order = np.lexsort((at, of))
        of, token, at = of[order], token[order], at[order]
    return of, token, at


def load(model: bytes) -> PieceModel:
    """The tables of a model file's content, made once in a process."""
    key = hash(model)
    if key not in _loaded:
        _loaded[key] = PieceModel(model)
    return _loaded[key]
