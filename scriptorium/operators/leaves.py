"""Hits of many leaves at once.

The posting rows that some leaf needs meet by document in one shuffle. They travel packed: a task gathers many rows, puts
those of a document side by side and sends those of a bucket of documents as one block of compressed arrays. Where
the rows of a bucket meet, phrases are followed token by token through a trie of all phrases, in all its documents at once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scriptorium.functions.text import FIELDS, WEIGHTS

#: Numbers of fields, by name, and their weights in that order.
FIELD_ORDER = tuple(sorted(FIELDS))
_WEIGHTS = np.array([WEIGHTS[f] for f in FIELD_ORDER])
#: What a task gathers before it packs: posting rows, and bytes of them.
PACK_ROWS, PACK_BYTES = 2_000_000, 128 * 1024**2
#: Positions of a row that is sent to be packed: a batch of rows is bounded by this.
RUN = 4_096
#: Tokens of the documents of a bucket, about.
BUCKET_TOKENS = 2_000_000
#: What tells the documents of posting rows apart; those with the same path are copies.
KEYS = ("path", "ext", "dl", "segment", "ord")
PACK_SCHEMA = "bucket int, data binary"
#: One row for each path: its hits, with length and place of the copy that each is in.
FOUND_SCHEMA = "path string, ext string, leaf array<int>, f array<double>, dl array<bigint>, segment array<int>, ord array<bigint>"


def packed(batches):
    """Rows ``bucket, code, path, ext, dl, segment, ord, field, n`` as one block for each bucket and gathering. Rows whose
    positions count have them in runs: ``run, positions``."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield _blocks(pa.Table.from_batches(held))
            held, rows, size = [], 0, 0
    if rows:
        yield _blocks(pa.Table.from_batches(held))


def _array(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return _array(table, name).to_numpy(zero_copy_only=False)


def _codes(table: pa.Table, name: str) -> np.ndarray:
    """Equal strings as equal numbers."""
    return pc.fill_null(_array(table, name).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for values in columns:
        new[1:] |= values[1:] != values[:-1]
    return new


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _blocks(rows: pa.Table) -> pa.RecordBatch:
    keys = [_numbers(rows, "bucket"), _codes(rows, "path"), _codes(rows, "ext"), *[_numbers(rows, k) for k in KEYS[2:]]]
    whole = "positions" in rows.schema.names
    code = [_numbers(rows, c).astype(np.int32) for c in ("code", "field")] + ([_numbers(rows, "run")] if whole else [])
    order = np.lexsort((*code[::-1], *keys[::-1]))
    keys, code, n = [k[order] for k in keys], [c[order] for c in code], _numbers(rows, "n")[order]
    new = _starts(keys)
    columns = {}
    if whole:
        positions = _array(rows, "positions").take(pa.array(order))
        held = pc.fill_null(pc.list_value_length(positions), 0).to_numpy(zero_copy_only=False)
        flat = positions.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        begins = _ends(held)
        # each row's first position as it is, the others less the one before
        steps = np.diff(flat, prepend=np.int32(0))
        heads = begins[:-1][held > 0]
        steps[heads] = flat[heads]
        columns["run"] = code.pop()
    else:
        # the terms that a prefix begins add up
        kept = np.flatnonzero(new | _starts(code))
        n = np.add.reduceat(n, kept)
        order, new, keys, code = order[kept], new[kept], [k[kept] for k in keys], [c[kept] for c in code]
        columns["run"] = np.zeros(len(order), np.int32)
        begins, steps = np.zeros(len(order) + 1, np.int64), np.empty(0, np.int32)
    first = np.flatnonzero(new)
    bucket, ends = keys[0][first], np.append(first, len(order))
    columns = {name: _lists(ends, v) for name, v in (columns | dict(zip(("code", "field"), code), n=n.astype(np.int32))).items()}
    columns["steps"] = _lists(begins[ends], steps)
    at = pa.array(order[first])
    columns |= {name: _array(rows, name).take(at) for name in KEYS}
    whole = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    edges = np.append(np.flatnonzero(_starts([bucket])), len(bucket))
    data = [_bytes(whole.slice(low, high - low)) for low, high in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "data"])


def _bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


@dataclass(frozen=True)
class Leaves:
    """All leaves of a batch as numbers.

    Codes below ``terms`` are index terms; ``terms`` plus a leaf is a term that this leaf, a prefix of one token, begins.
    """

    terms: int
    #: Whether the rows of a code have their positions.
    whole: np.ndarray
    #: The field that a leaf asks for, or -1.
    field: np.ndarray
    #: Codes, in order, and the leaf of one token that each is a hit of.
    single: tuple[np.ndarray, np.ndarray]
    #: For each token of the longest phrase: states that go on, and those that end a leaf, as state and term in one number.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: leaf, m, off, code of the phrases whose tokens are all in the vocabulary, and the offset of each leaf's rarest token.
    phrases: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    anchor: dict[int, int]


def leaves_of(count: int, terms: int, field: np.ndarray, prefixes: np.ndarray, rows: dict[str, np.ndarray]) -> Leaves:
    """From the rows ``leaf, m, off, code, n`` of the leaves' index terms."""
    leaf, m, off, code, n = (rows[c].astype(np.int64) for c in ("leaf", "m", "off", "code", "n"))
    whole = np.zeros(terms + count, bool)
    whole[code[m > 1]] = True
    one = m == 1
    codes, ones = np.append(code[one], terms + prefixes), np.append(leaf[one], prefixes)
    order = np.argsort(codes, kind="stable")
    order_of = np.lexsort((off, leaf))
    leaf, m, off, code, n = (v[order_of] for v in (leaf, m, off, code, n))
    known = np.bincount(leaf, _starts([leaf, off]), count) if len(leaf) else np.zeros(count)
    kept = (m > 1) & (known[leaf] == m)
    leaf, m, off, code, n = (v[kept] for v in (leaf, m, off, code, n))
    levels, state = [], np.zeros(count, np.int64)
    for k in range(int(m.max()) if len(m) else 0):
        at = off == k
        step, last = state[leaf[at]] * terms + code[at], m[at] == k + 1
        ending, by = step[last], np.argsort(step[last], kind="stable")
        inner, number = np.unique(step[~last], return_inverse=True)
        state[leaf[at][~last]] = number
        levels.append((inner, ending[by], leaf[at][last][by]))
    rarest: dict[int, tuple[int, int]] = {}
    if len(leaf):
        first = np.flatnonzero(_starts([leaf, off]))
        for i, total in zip(first, np.add.reduceat(n, first)):
            best = (int(total), int(off[i]))
            rarest[int(leaf[i])] = min(rarest.get(int(leaf[i]), best), best)
    anchor = {key: at for key, (_, at) in rarest.items()}
    return Leaves(terms, whole, field, (codes[order], ones[order]), levels, (leaf, m, off, code), anchor)


def _matches(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a value and a place of it in the sorted keys: numbers of values, places."""
    low, high = np.searchsorted(keys, values), np.searchsorted(keys, values, "right")
    counts = high - low
    row = np.repeat(np.arange(len(values)), counts)
    return row, np.arange(len(row)) - np.repeat(_ends(counts)[:-1] - low, counts)


def found(blocks: pa.Table, leaves: Leaves) -> pa.Table:
    """The hits in the documents of a bucket, from all its blocks."""
    pieces = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks["data"].to_pylist()])
    keys = [_codes(pieces, "path"), _codes(pieces, "ext"), *[_numbers(pieces, k) for k in KEYS[2:]]]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = _starts(keys)
    doc_of = np.empty(len(order), np.int64)
    doc_of[order] = np.cumsum(new) - 1
    document = pieces.select(list(KEYS)).take(pa.array(order[new]))
    # copies of a path are neighbours
    path_of = np.cumsum(_starts([k[new] for k in keys[:2]])) - 1

    lists = {name: _array(pieces, name) for name in ("code", "field", "n", "run", "steps")}
    code, field, n, run, steps = (lists[name].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for name in lists)
    doc = np.repeat(doc_of, lists["code"].value_lengths().to_numpy(zero_copy_only=False))
    row, place = _matches(leaves.single[0], code)
    hits = [(doc[row], leaves.single[1][place], field[row], n[row])]

    held = np.where(leaves.whole[code], n, 0)
    sums, begins = np.cumsum(steps), _ends(held)[:-1][held > 0]
    pos = sums - np.repeat(sums[begins] - steps[begins], held[held > 0])
    token = np.repeat(np.arange(len(code)), held)
    twice = _repeated(path_of, doc, field, code, run, held > 0)
    plain = ~twice[path_of[doc[token]]]
    hits.append(_phrases(leaves, doc[token[plain]], field[token[plain]], code[token[plain]], pos[plain]))
    token, pos = token[~plain], pos[~plain]
    if len(token):
        hits.append(_phrases_of_copies(leaves, path_of, doc[token], field[token], code[token], pos))

    doc, leaf, field, n = (np.concatenate(parts) for parts in zip(*hits))
    wanted = leaves.field[leaf]
    kept = (wanted < 0) | (wanted == field)
    pair, number = np.unique(doc[kept] * len(leaves.field) + leaf[kept], return_inverse=True)
    f = np.bincount(number, _WEIGHTS[field[kept]] * n[kept], len(pair))
    doc, leaf = pair // len(leaves.field), pair % len(leaves.field)
    first = np.flatnonzero(_starts([path_of[doc]])) if len(doc) else np.empty(0, np.int64)
    ends, at = np.append(first, len(doc)), pa.array(doc[first])
    columns = {name: _array(document, name).take(at) for name in ("path", "ext")}
    columns |= {"leaf": _lists(ends, leaf.astype(np.int32)), "f": _lists(ends, f.astype(np.float64))}
    columns |= {name: _lists(ends, _numbers(document, name)[doc]) for name in KEYS[2:]}
    return pa.table(columns)


def _repeated(path_of: np.ndarray, doc: np.ndarray, field: np.ndarray, code: np.ndarray, run: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Paths with several documents, or with several rows of a term and field in one that they are not told apart from."""
    twice = np.bincount(path_of) > 1
    doc, field, code, run = doc[whole], field[whole], code[whole], run[whole]
    if len(doc):
        order = np.lexsort((run, code, field, doc))
        again = ~_starts([doc[order], field[order], code[order], run[order]])
        twice[path_of[doc[order][again]]] = True
    return twice


def _phrases(leaves: Leaves, doc: np.ndarray, field: np.ndarray, code: np.ndarray, pos: np.ndarray):
    """Where phrases begin: document, leaf, field and a one for each place."""
    # positions of a field in a row: a token's neighbour is the next number
    key = (doc * len(FIELD_ORDER) + field << 32) + pos
    order = np.argsort(key)
    key, code = key[order], code[order]
    starts, state, begun, ended = np.arange(len(key)), np.zeros(len(key), np.int64), [], []
    for k, (inner, ending, leaf) in enumerate(leaves.levels):
        if k:
            near = starts + k < len(key)
            starts, state = starts[near], state[near]
            near = key[starts + k] == key[starts] + k
            starts, state = starts[near], state[near]
        step = state * leaves.terms + code[starts + k]
        row, place = _matches(ending, step)
        begun.append(starts[row])
        ended.append(leaf[place])
        at = np.minimum(np.searchsorted(inner, step), max(len(inner) - 1, 0))
        going = inner[at] == step if len(inner) else np.zeros(len(step), bool)
        starts, state = starts[going], at[going]
    none = np.empty(0, np.int64)
    begun, ended = np.concatenate([none, *begun]), np.concatenate([none, *ended])
    group = key[begun] >> 32
    return group // len(FIELD_ORDER), ended, group % len(FIELD_ORDER), np.ones(len(begun), np.int64)


def _phrases_of_copies(leaves: Leaves, path_of: np.ndarray, doc: np.ndarray, field: np.ndarray, code: np.ndarray, pos: np.ndarray):
    """The same where a path comes more than once: a place counts if, over all copies, as many of the other tokens stand beside
    the rarest one as the phrase has."""
    starting, others, length = defaultdict(list), defaultdict(list), {}
    for leaf, m, off, term in zip(*(v.tolist() for v in leaves.phrases)):
        (starting[term] if off == leaves.anchor[leaf] else others[leaf]).append((leaf, off) if off == leaves.anchor[leaf] else (off, term))
        length[leaf] = m
    hits = []
    order = np.argsort(path_of[doc], kind="stable")
    edges = np.append(np.flatnonzero(_starts([path_of[doc[order]]])), len(order))
    for low, high in zip(edges[:-1], edges[1:]):
        part = order[low:high]
        tokens = list(zip(doc[part].tolist(), field[part].tolist(), code[part].tolist(), pos[part].tolist()))
        there = Counter(token[1:] for token in tokens)
        begun = Counter((d, leaf, f, p - off) for d, f, term, p in tokens for leaf, off in starting.get(term, ()))
        for (d, leaf, f, start), times in begun.items():
            beside = sum(there.get((f, term, start + off), 0) for off, term in others[leaf])
            if times * beside == length[leaf] - 1:
                hits.append((d, leaf, f, 1))
    return tuple(np.array(hits, np.int64).reshape(-1, 4).T)
