"""Removal of long repeated passages by blockwise suffix sorting with a difference cover.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same
document or another, is removed; strings are judged on the input.

A window is the first ``length`` bytes of a suffix; two documents share a passage exactly where
windows are equal, and equal windows are neighbours once suffixes are sorted. What decides is
that sort, and bytes: hashes only deal windows out, and prune those that are proven not to
repeat. Windows are dealt by the least hash of the ``GRAM``-byte grams they hold: equal windows
hold equal grams, so they always meet. Neighbouring windows mostly have the same least gram, so
a bucket receives pieces: runs of windows, standing for the bytes they cover.

1.  Each task cuts its documents into pieces. Pieces of one task with the same bytes (compared,
    not only hashed) are combined before anything is sent.
2.  A piece alone in its bucket (and not periodic) is pruned: its windows hold a gram that no
    other piece holds. A bucket that a look at a part of the documents shows to hold a large
    share of all pieces is dealt out by content instead, its pieces taken to share it.
3.  Only the other pieces' bytes are fetched and dealt out by bucket. A bucket that holds very
    many is split by the bytes that all windows of a sub-bucket must share.
4.  A task lays the pieces it received end to end, a block of text at a time, those that are equal
    byte for byte once: they are known to repeat, and one stands for them. The suffixes at the
    sample positions of a difference cover are ranked first, by prefix doubling. Then one suffix
    bucket (a range of leading bytes) after another is sorted: by two leading words, and ties by
    the cover: any two suffixes reach sample positions together within ``PERIOD`` bytes, so
    their order is that of two sample ranks. Neighbours that agree in ``length`` bytes repeat.

Memory is bounded by the block of text a task sorts; there are ranks for 5 positions in 16, not
for all. Nothing is gathered in the driver but the list of heavy buckets.

Null and empty texts, and texts shorter than ``length``, lose nothing. Rows equal in id and text
are documents like any other: each one's windows also start in the other. Ids may be null or
repeat. An empty table gives an empty result. New columns replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import drop, free_name, save, tune, utf8

#: Bytes of a gram; windows handled at once; pieces held before they are combined and sent.
GRAM, BLOCK, HELD = 56, 1 << 20, 400_000
#: Pieces in one bucket beyond which it is split, and the windows of a sub-bucket.
HOT, SUB = 512, 16
#: The difference cover: residues of the period such that every difference occurs. Suffixes in one bucket, about.
PERIOD, COVER, BUCKET = 16, np.array([0, 1, 2, 5, 8], np.int64), 1 << 16

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble a fresh array of 64-bit hashes."""
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which any substring's hash follows."""
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """The hash of every substring of ``size`` bytes."""
    _, down = _power(len(prefix))
    return _mix((prefix[size:] - prefix[:-size]) * down[: len(prefix) - size])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(bucket, content hash, periodic, item, start, last start) of the pieces of items laid end to end."""
    prefix = _prefix(data)
    grams = _hashes(prefix, GRAM)
    width = length - GRAM + 1
    least, have = grams, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    sizes = np.maximum(0, np.diff(offsets) - length + 1)
    at = _ranges(offsets[:-1], sizes)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none.astype(bool), none, none, none
    item = np.repeat(np.arange(len(sizes)), sizes)
    value = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (item[1:] != item[:-1])
    begun = np.flatnonzero(fresh)
    into = np.arange(len(at)) - np.repeat(begun, np.diff(np.append(begun, len(at))))
    fresh |= into % width == 0
    begun = np.flatnonzero(fresh)
    many = np.diff(np.append(begun, len(at)))
    first, bucket = at[begun], value[begun]
    span = many + length - 1
    _, down = _power(len(prefix))
    content = _mix((prefix[first + span] - prefix[first]) * down[first] + many.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    inside = many + width - 1
    hits = grams[_ranges(first, inside)] == np.repeat(bucket, inside)
    periodic = np.add.reduceat(hits, np.cumsum(inside) - inside) > 1
    start = first - offsets[:-1][item[begun]]
    return bucket, content, periodic, item[begun], start, start + many - 1


def _items(texts: list[bytes], length: int):
    """(document, offset, bytes): whole texts, or overlapping parts of very long ones."""
    for doc, text in enumerate(texts):
        for k in range(0, max(0, len(text) - length + 1), BLOCK):
            yield doc, k, text[k : k + BLOCK + length - 1]


_PIECE = "route long, bucket long, kind int, ua long, ub long, first long, last long"
#: Kinds of piece: alone in its task, periodic, one that stands for several with its bytes in its task, one it stands for.
_ALONE, _PERIODIC, _SEVERAL, _SETTLED = range(4)
#: Added to the kind of a piece in a heavy bucket: its route is a hash of bucket and content.
_HEAVY = 8
#: A bucket is heavy with so many pieces in one of so many parts of the documents; at most so many are told apart.
HEAVY_PIECES, HEAVY_PART, HEAVY_MOST = 5_000, 64, 100_000


def _batch(columns, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "))], names=names)


def _same_bytes(order: np.ndarray, same: np.ndarray, blocks: list[bytes], block: np.ndarray, at: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Which pieces, in order, have the bytes of the first of their run of equal hashes; ``same``: equal hashes to the one before."""
    out = np.zeros(len(order), bool)
    members = np.flatnonzero(same)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))[members]
    block, at, span = ([x[order[i]].tolist() for i in (first, members)] for x in (block, at, span))
    out[members] = [m == n and blocks[a][p : p + m] == blocks[b][q : q + n] for a, b, p, q, m, n in zip(*block, *at, *span)]
    return out


def _cut(length: int, heavy: np.ndarray):
    """Documents (ua, ub, text) to pieces, those of a task with equal bytes combined; those of heavy buckets dealt by content."""

    def send(held, blocks):
        bucket, content, periodic, ua, ub, first, last, block, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((content, bucket))
        same = np.append(False, (bucket[order][1:] == bucket[order][:-1]) & (content[order][1:] == content[order][:-1]))
        after = _same_bytes(order, same, blocks, block, at, last - first + length)
        stands = np.zeros(len(order), bool)
        stands[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))[after]] = True
        kind = np.empty(len(order), np.int32)
        kind[order] = np.where(after, _SETTLED, np.where(stands, _SEVERAL, np.where(periodic[order], _PERIODIC, _ALONE)))
        live = kind != _SETTLED
        mass = np.isin(bucket.view(np.int64), heavy)
        route = np.where(mass, _mix(bucket * _U(0xD6E8FEB86659FD93) ^ content), bucket)
        yield _batch([x[live] for x in (route.view(np.int64), bucket.view(np.int64), kind + _HEAVY * mass, ua, ub, first, last)], _PIECE)
        if not live.all():
            ua, ub, first, last = (x[~live] for x in (ua, ub, first, last))
            order = np.lexsort((first, ub, ua))
            ua, ub, first, last = (x[order] for x in (ua, ub, first, last))
            new = np.append(True, (ua[1:] != ua[:-1]) | (ub[1:] != ub[:-1]) | (first[1:] != last[:-1] + 1))
            ends = np.append(np.flatnonzero(new)[1:], len(new)) - 1
            ua, ub, first, last = ua[new], ub[new], first[new], last[ends]
            yield _batch([ua ^ first * 0x9E37, ub, np.full(len(ua), _SETTLED), ua, ub, first, last], _PIECE)

    def run(batches):
        held, count, blocks = [], 0, []
        for batch in batches:
            ua, ub = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            block, size = [], 0
            for last in (False, True):
                for doc, k, part in _items(utf8(batch.column(2)), length) if not last else [(0, 0, b"")]:
                    if block and (last or size + len(part) > BLOCK):
                        whole = b"".join(x[2] for x in block)
                        offsets = np.concatenate(([0], np.cumsum([len(x[2]) for x in block])))
                        bucket, content, periodic, item, first, to = pieces(np.frombuffer(whole, np.uint8), offsets, length)
                        docs, base = np.array([x[0] for x in block]), np.array([x[1] for x in block])
                        at = first + offsets[item]
                        held.append((bucket, content, periodic, ua[docs[item]], ub[docs[item]], first + base[item], to + base[item], np.full(len(at), len(blocks)), at))
                        blocks.append(whole)
                        count += len(bucket)
                        block, size = [], 0
                        if count > HELD:
                            yield from send(held, blocks)
                            held, count, blocks = [], 0, []
                    block.append((doc, k, part))
                    size += len(part)
        if held:
            yield from send(held, blocks)

    return run


def _whole_groups(batches, column: int, enough):
    """Tables of whole groups, from rows sorted by ``column``; as many groups as ``enough`` asks for."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column(column)
        if enough(held) and key[0] != key[-1]:
            cut = int(np.searchsorted(key.to_numpy(zero_copy_only=False), key[-1].as_py()))
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif enough(held) and len(held) > 1 and held[-2].column(column)[-1] != key[0]:
            yield pa.Table.from_batches(held[:-1])
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


_STATUS = "kind int, split boolean, bucket long, ua long, ub long, first long, last long"
#: Kinds of status: windows that repeat; a piece whose bytes must be sorted; one of known windows that others may equal.
_REPEATS, _OPEN, _PARTNER = range(3)


def _prune(hot: int):
    """Pieces sorted by route to those that share their bucket; what is alone in it is proven not to repeat."""

    def run(batches):
        for table in _whole_groups(batches, 0, lambda held: sum(b.num_rows for b in held) >= 20_000):
            route, bucket, kind, ua, ub, first, last = (table.column(i).to_numpy() for i in range(7))
            mass, done = kind >= _HEAVY, kind == _SETTLED
            kind = kind % _HEAVY
            group = np.cumsum(np.append(True, route[1:] != route[:-1])) - 1
            many = np.bincount(group, ~done)[group]
            known = ~done & (kind == _SEVERAL)
            met = ~done & (mass | (many > 1))
            open_ = ~done & ~known & (met | (kind == _PERIODIC))
            split = mass | (many > hot)
            for rows, status in ((done | known, _REPEATS), (open_, _OPEN), (known & met, _PARTNER)):
                if rows.any():
                    yield _batch([np.full(rows.sum(), status), split[rows], bucket[rows], ua[rows], ub[rows], first[rows], last[rows]], _STATUS)

    return run


#: context is null where all of a row's windows are known to repeat.
_CONTEXT = "key long, open boolean, ua long, ub long, first long, windows long, context binary"


def sub_buckets(context: bytes, bucket: int, length: int) -> list[tuple[int, int, int]]:
    """(key, first window, last window) of a hot bucket's piece, split so that equal windows keep equal keys.

    Windows go by their distance to the bucket's gram, SUB distances together; all windows of
    such a group share the bytes around the gram, and a hash of those bytes is part of the key.
    """
    prefix = _prefix(np.frombuffer(context, np.uint8))
    places = np.flatnonzero(_hashes(prefix, GRAM) == _U(bucket))
    windows = np.arange(len(context) - length + 1)
    place = places[np.searchsorted(places, windows)]
    group = (place - windows) // SUB
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (group[1:] != group[:-1])))
    ends = np.append(new[1:], len(windows)) - 1
    _, down = _power(len(prefix))
    a = place[new] - group[new] * SUB
    core = (prefix[a + length - SUB + 1] - prefix[a]) * down[a]
    keys = _mix(core + group[new].astype(np.uint64) * _U(0xA24BAED4963EE407) + _U(bucket))
    return list(zip(keys.view(np.int64).tolist(), new.tolist(), ends.tolist()))


def _fetch(length: int):
    """Rows (ua, ub, text, asked) to the bytes of the pieces asked for."""

    def send(shared):
        """One row stands for rows of a batch with the same key and bytes; the windows of each of them are known to repeat."""
        out = []
        for (key, context), rows in shared.items():
            out.append((key, rows[0][0] and len(rows) == 1, *rows[0][1:], context))
            if len(rows) > 1:
                out += [(row[1] ^ row[3], *row, None) for row in rows if row[0]]
        yield _batch(list(zip(*out)), _CONTEXT)

    def run(batches):
        for batch in batches:
            size, shared = 0, {}
            ua, ub = (batch.column(i).to_pylist() for i in (0, 1))
            for n, text in enumerate(utf8(batch.column(2))):
                for x in batch.column(3)[n].as_py():
                    context, open_ = text[x["first"] : x["last"] + length], x["kind"] == _OPEN
                    parts = sub_buckets(context, x["bucket"] % 2**64, length) if x["split"] else [(x["bucket"], 0, x["last"] - x["first"])]
                    for key, a, b in parts:
                        rows = shared.setdefault((key, context[a : b + length]), [])
                        size += 0 if rows else b - a + length
                        rows.append((open_, ua[n], ub[n], x["first"] + a, b - a + 1))
                    if size > 8 * BLOCK:
                        yield from send(shared)
                        size, shared = 0, {}
            if shared:
                yield from send(shared)

    return run


def _shifts() -> np.ndarray:
    """For two residues, the least shift that takes both into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[COVER] = True
    both = np.array([[[inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD] for d in range(PERIOD)] for b in range(PERIOD)] for a in range(PERIOD)])
    return both.argmax(2)


SHIFT = _shifts()
_SLOT = np.full(PERIOD, -1)
_SLOT[COVER] = np.arange(len(COVER))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as a number in the order of bytes; zeros follow the end."""
    return np.ndarray((len(data) + PERIOD,), ">u8", data.tobytes() + bytes(PERIOD + 8), 0, (1,))


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """The rank, in suffix order, of each of the suffixes at the cover's sample positions below ``n``.

    Ranks after the first PERIOD bytes double their reach until no two tie: a sample position plus
    a multiple of the period is one too. Of two suffixes with one a beginning of the other the shorter comes first.
    """
    sample = (np.arange(-(-n // PERIOD))[:, None] * PERIOD + COVER).ravel()
    sample = sample[sample < n]
    one, two = (words[sample + k].astype(np.uint64) for k in (0, 8))
    live = np.lexsort((two, one))
    fresh = np.append(True, (one[live][1:] != one[live][:-1]) | (two[live][1:] != two[live][:-1]))
    rank, step = np.empty(len(sample), np.int64), len(COVER)
    begun = np.flatnonzero(fresh)
    size = np.diff(np.append(begun, len(live)))
    rank[live] = np.repeat(begun, size)
    live = live[np.repeat(size > 1, size)]
    while len(live):
        inside = live + step < len(sample)
        later = np.where(inside, rank[np.minimum(live + step, len(sample) - 1)], live - len(sample) - step)
        held = rank[live]
        order = np.lexsort((later, held))
        live, later, held = live[order], later[order], held[order]
        group = np.append(True, held[1:] != held[:-1])
        part = group | np.append(True, later[1:] != later[:-1])
        place = np.arange(len(live))
        first_of_group, first_of_part = (np.maximum.accumulate(np.where(x, place, 0)) for x in (group, part))
        rank[live] = held + first_of_part - first_of_group
        size = np.diff(np.append(np.flatnonzero(part), len(live)))
        live, step = live[np.repeat(size > 1, size)], step * 2
    return rank


def _settle_ties(at: np.ndarray, tie: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Suffixes that tie in their leading words, put in order group by group; ``tie`` numbers the groups in order.

    Suffixes of one residue are in the order of one sample rank; the lists of two residues merge
    by the ranks at the shift that takes both into the cover.
    """

    def keys(part: slice, residue: int, shift: int) -> np.ndarray:
        return tie[part] * (len(rank) + 1) + rank[(at[part] + shift) // PERIOD * len(COVER) + _SLOT[(residue + shift) % PERIOD]]

    order = np.argsort(at % PERIOD, kind="stable")
    at, tie = at[order], tie[order]
    edges = np.searchsorted(at % PERIOD, np.arange(PERIOD + 1)).tolist()
    parts = [(a, slice(i, j)) for a, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
    place = np.empty(len(at), np.int64)
    for a, own in parts:
        by = np.argsort(keys(own, a, int(SHIFT[a, a])), kind="stable")
        at[own], tie[own] = at[own][by], tie[own][by]
        place[own] = np.arange(len(by))
    for i, (a, one) in enumerate(parts):
        for b, other in parts[:i]:
            shift = int(SHIFT[a, b])
            x, y = keys(one, a, shift), keys(other, b, shift)
            place[one] += np.searchsorted(y, x)
            place[other] += np.searchsorted(x, y)
    out = at.copy()
    out[place] = at
    return out


def suffix_buckets(data: np.ndarray, starts: np.ndarray, most: int = BUCKET):
    """The suffixes at ``starts`` in suffix order, one bucket after another; each position once."""
    words = _words(data)
    rank = cover_ranks(words, len(data))
    lead = (words[starts].astype(np.uint64) >> np.uint64(48)).astype(np.int64)
    counts = np.bincount(lead, minlength=1 << 16)
    of = ((np.cumsum(counts) - counts) // most)[lead]  # leading byte pairs, together as far as they go in one bucket
    by = np.argsort(of, kind="stable")
    for own in np.split(starts[by], np.flatnonzero(np.diff(of[by])) + 1):
        one, two = (words[own + k].astype(np.uint64) for k in (0, 8))
        order = np.lexsort((two, one))
        own, one, two = own[order], one[order], two[order]
        fresh = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(own) else np.zeros(0, bool)
        group = np.cumsum(fresh) - 1
        tied = np.bincount(group)[group] > 1 if len(own) else fresh
        if tied.any():
            own[tied] = _settle_ties(own[tied], group[tied], rank)
        yield own


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each window start, whether an equal window starts at another of ``starts``."""
    words, hit = _words(data), np.zeros(len(data) + 1, bool)
    steps = (*range(0, length - 7, 8), length - 8)
    for own in suffix_buckets(data, starts):
        same = np.arange(max(0, len(own) - 1))
        for at in steps:  # neighbours are compared byte by byte
            same = same[words[own[same] + at] == words[own[same + 1] + at]]
        hit[own[same]] = hit[own[same + 1]] = True
    return hit[starts]


_SPAN = "ua long, ub long, first long, last long"


def _sort(length: int):
    """Pieces' bytes sorted by key to the windows of open pieces that repeat."""

    def run(batches):
        for table in _whole_groups(batches, 0, lambda held: sum(b.column(6).nbytes for b in held) >= BLOCK):
            known = table.column(6).is_null().to_numpy()
            key, open_, ua, ub, first, windows = (table.column(i).to_numpy() for i in range(6))
            if known.any():
                yield _batch([ua[known], ub[known], first[known], (first + windows - 1)[known]], _SPAN)
                key, open_, ua, ub, first, windows = (x[~known] for x in (key, open_, ua, ub, first, windows))
            contexts = table.column(6).drop_null()
            if not len(contexts):
                continue
            # pieces equal byte for byte are each other's repeats; the first of them is sorted for all
            coded = contexts.cast(pa.large_binary()).combine_chunks().dictionary_encode()
            of = coded.indices.to_numpy()
            many_of = np.bincount(of)[of] > 1
            known = many_of & open_
            if known.any():
                yield _batch([ua[known], ub[known], first[known], (first + windows - 1)[known]], _SPAN)
            stands = np.zeros(len(of), bool)
            stands[np.unique(of, return_index=True)[1]] = True
            key, open_, ua, ub, first = (x[stands] for x in (key, open_ & ~many_of, ua, ub, first))
            live = np.isin(key, key[open_])  # elsewhere nothing is left to find
            if not live.any():
                continue
            open_, ua, ub, first = (x[live] for x in (open_, ua, ub, first))
            contexts = coded.dictionary.filter(pa.array(live)).to_pylist()
            data = np.frombuffer(b"".join(contexts), np.uint8)
            size = np.array([len(x) for x in contexts])
            offsets = np.cumsum(size) - size
            many = size - length + 1
            starts = _ranges(offsets, many)
            hit = repeated_windows(data, starts, length) & np.repeat(open_, many)
            item = np.repeat(np.arange(len(size)), many)
            at = np.flatnonzero(hit)
            if len(at):
                new = np.append(True, (np.diff(at) > 1) | (item[at][1:] != item[at][:-1]))
                begun = np.flatnonzero(new)
                ends = np.append(begun[1:], len(at)) - 1
                own = item[at[begun]]
                yield _batch([ua[own], ub[own], first[own] + starts[at[begun]] - offsets[own], first[own] + starts[at[ends]] - offsets[own]], _SPAN)

    return run


def _strip(held: int, length: int, names: list[str], whole_chars: bool):
    """Documents with their windows that repeat to spans and what is kept."""

    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for n, text in enumerate(utf8(batch.column(held))):
                merged: list[list[int]] = []
                for x in sorted((x["first"], x["last"]) for x in batch.column(held + 1)[n].as_py() or []):
                    a, b = x[0], x[1] + length
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                if whole_chars:  # a character cut by a span's edge is kept
                    for s in merged:
                        while s[0] < s[1] and text[s[0]] & 0xC0 == 0x80:
                            s[0] += 1
                        while s[1] > s[0] and s[1] < len(text) and text[s[1]] & 0xC0 == 0x80:
                            s[1] -= 1
                at, parts = 0, []
                for a, b in merged:
                    parts.append(text[at:a])
                    at = b
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join([*parts, text[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(held)), pa.array([len(x) for x in utf8(batch.column(held))], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=names)

    return run


def heavy_buckets(keyed: DataFrame, length: int, pieces: int, part: int) -> np.ndarray:
    """Buckets with at least ``pieces`` pieces in one of ``part`` parts of the documents; never more than HEAVY_MOST.

    Only how pieces are dealt out depends on them, not what is found.
    """
    some = keyed.where(F.pmod("ua", F.lit(part)) == 0).mapInArrow(_cut(length, np.zeros(0, np.int64)), _PIECE)
    many = some.where(F.col("kind") != _SETTLED).groupBy("route").count().where(F.col("count") >= pieces)
    return np.array([r["route"] for r in many.orderBy(F.col("count").desc(), "route").limit(HEAVY_MOST).collect()], np.int64)


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, whole_chars: bool = False, hot: int = HOT, heavy: tuple[int, int] = (HEAVY_PIECES, HEAVY_PART)) -> DataFrame:
    """``docs`` without its text, with n_bytes, spans (removed, as byte offsets) and kept (the remaining bytes).

    With ``whole_chars`` a character that a span's edge would cut is kept. ``length``: twice GRAM at least.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    spark = docs.sparkSession
    tune(spark)
    body, who = F.col(f"`{text}`").cast("string"), F.col(f"`{id_col}`")
    keys = {"ua": F.xxhash64(who, body), "ub": F.xxhash64(body, F.lit(1), who)}
    keyed = docs.select(*[v.alias(k) for k, v in keys.items()], body.alias("text"))
    long = keyed.where(F.octet_length("text") >= length)
    cut = long.mapInArrow(_cut(length, heavy_buckets(long, length, *heavy)), _PIECE)
    status = save(cut.repartition("route").sortWithinPartitions("route").mapInArrow(_prune(hot), _STATUS), "suffix-status")
    asked = status.where(F.col("kind") != _REPEATS).groupBy("ua", "ub").agg(F.collect_set(F.struct("kind", "split", "bucket", "first", "last")).alias("asked"))
    fetched = keyed.join(asked, ["ua", "ub"]).select("ua", "ub", "text", "asked").mapInArrow(_fetch(length), _CONTEXT)
    found = save(fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(length), _SPAN), "suffix-found")
    spans = status.where(F.col("kind") == _REPEATS).select("ua", "ub", "first", "last").unionByName(found)
    spans = save(spans.groupBy("ua", "ub").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "suffix-spans")
    drop(status, found)
    new = ("n_bytes", "spans", "kept")
    a, b, whole, hit = (free_name(docs, x) for x in ("ua", "ub", "body", "hit"))
    own = [c for c in docs.columns if c != text and c.lower() not in new]
    full = docs.select(*[F.col(f"`{c}`") for c in own], body.alias(whole), keys["ua"].alias(a), keys["ub"].alias(b))
    joined = full.join(spans.toDF(a, b, hit), [a, b], "left").select(*[F.col(f"`{c}`") for c in own], whole, hit)
    schema = joined.drop(whole, hit).schema
    for field in spark.createDataFrame([], "n_bytes long, spans array<struct<start: long, end: long>>, kept binary").schema:
        schema = schema.add(field)
    return joined.mapInArrow(_strip(len(own), length, [*own, *new], whole_chars), schema)
