"""Batch helpers that run inside Arrow UDFs: placing a structure and naming it canonically.

A structure of n blocks is two arrays: ``species[n]`` and ``partner[n * stride]`` where slot
``(i - 1) * stride + s`` is site s of block i and holds the slot it is bound to (0 = open).
Each helper works on a whole Arrow batch with numpy; rows are grouped by size first, so the
list columns become plain 2-D arrays without copying per row.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from ..blocks import FACE_TOLERANCE, OVERLAP_SLACK, qmul, qrot


# ------------------------------------------------------------------- Arrow plumbing

PIECE_CELLS = 8_000_000


def by_size(species: pa.Array, partner: pa.Array, stride: int):
    """Yield ``(row_numbers, species[B, n], partner[B, n*stride])`` for every size n, in pieces
    that keep temporary arrays small whatever the size of the Arrow batch."""
    sizes = np.diff(species.offsets.to_numpy())
    flat_species = species.flatten().to_numpy(zero_copy_only=False)
    flat_partner = partner.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for n in np.unique(sizes):
        alike = np.flatnonzero(sizes == n)
        step = max(16, PIECE_CELLS // int(max(1, n) * max(n, 24 * stride)))  # bounds what is made per row and start frame
        for rows in (alike[i:i + step] for i in range(0, len(alike), step)):
            at = starts[rows]
            yield (rows, flat_species[at[:, None] + np.arange(n)],
                   flat_partner[(at * stride)[:, None] + np.arange(n * stride)])


def list_column(parts, n_rows: int, kind) -> pa.Array:
    """Arrow list column from ``[(row_numbers, values[B, k]), ...]`` covering all rows once."""
    if len(parts) == 1:
        values = parts[0][1]
        offsets = np.arange(n_rows + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel(), type=kind))
    width = np.zeros(n_rows, np.int64)
    for rows, values in parts:
        width[rows] = values.shape[1]
    offsets = np.concatenate([[0], np.cumsum(width)])
    flat = np.zeros(offsets[-1], parts[0][1].dtype if parts else np.int16)
    for rows, values in parts:
        flat[offsets[rows][:, None] + np.arange(values.shape[1])] = values
    return pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(flat, type=kind))


def scalar_column(parts, n_rows: int, kind) -> pa.Array:
    out = np.zeros(n_rows, parts[0][1].dtype if parts else np.int64)
    for rows, values in parts:
        out[rows] = values
    return pa.array(out, type=kind)


def binary_column(parts, n_rows: int) -> pa.Array:
    """Arrow binary column of the bytes of each row of ``[(row_numbers, values[B, k]), ...]``."""
    if not n_rows:
        return pa.array([], pa.binary())
    raw = [(rows, np.ascontiguousarray(values).view(np.uint8).reshape(len(rows), -1)) for rows, values in parts]
    lists = list_column(raw, n_rows, pa.uint8())
    return pa.Array.from_buffers(pa.binary(), n_rows, [None, lists.buffers()[1], lists.values.buffers()[1]])


# -------------------------------------------------------------------------- placing

def poses(lib: SimpleNamespace, species: np.ndarray, partner: np.ndarray):
    """Positions and rotations with block 1 at the origin, along bonds to earlier blocks."""
    b, n = species.shape
    k, rows = species - 1, np.arange(b)
    bonds = partner.reshape(b, n, lib.stride).astype(np.int64)
    x, q = np.zeros((b, n, 3)), np.zeros((b, n, 4))
    q[:, :1, 0] = 1.0
    for i in range(1, n):
        earlier = (bonds[:, i] > 0) & ((bonds[:, i] - 1) // lib.stride < i)
        s = earlier.argmax(axis=1)
        host, t = np.divmod(bonds[rows, i, s] - 1, lib.stride)
        kh, ki = k[rows, host], k[:, i]
        turn = qmul(lib.turns[kh, t], lib.refs[ki, s])
        step = lib.sites[kh, t] - qrot(lib.sites[ki, s], turn)
        x[:, i] = x[rows, host] + qrot(step, q[rows, host])
        q[:, i] = qmul(q[rows, host], turn)
    return x, q


def place_batch(lib: SimpleNamespace, species: pa.Array, partner: pa.Array) -> pa.StructArray:
    """Block positions and rotation quaternions of canonical structures, one list per component."""
    names = ["x", "y", "z", "qw", "qx", "qy", "qz"]
    parts = {name: [] for name in names}
    for rows, sp, pt in by_size(species, partner, lib.stride):
        x, q = poses(lib, sp, pt)
        for i, name in enumerate(names):
            parts[name].append((rows, x[:, :, i] if i < 3 else q[:, :, i - 3]))
    return pa.StructArray.from_arrays(
        [list_column(parts[name], len(species), pa.float64()) for name in names], names)


# ------------------------------------------------------------------------- attaching

CHUNK = 4096      # candidates compared at once, bounds the size of the temporary arrays


def contacts(lib, k, partner, x, q, parent, slot, label):
    """Place one new block per candidate and list what it touches.

    Returns ``(kept candidate numbers, hit[C, slots])``: candidates whose block overlaps a
    placed one or meets a bound face are gone; ``hit`` holds the new block's touching site.
    """
    m = lib.stride
    host, s = np.divmod(slot - 1, m)
    kh, kj, sj = k[parent, host], lib.species_of[label], lib.site_of[label]
    turn = qmul(lib.turns[kh, s], lib.refs[kj, sj])
    step = lib.sites[kh, s] - qrot(lib.sites[kj, sj], turn)
    centre = x[parent, host] + qrot(step, q[parent, host])
    spin = qmul(q[parent, host], turn)
    gap = np.sqrt(((x[parent] - centre[:, None]) ** 2).sum(axis=2))
    kp = k[parent]
    clash = (gap <= lib.r_max[kp] + lib.r_max[kj][:, None]) & (gap < 2 * lib.r_min[kp] - OVERLAP_SLACK)
    kept = np.flatnonzero(~clash.any(axis=1))
    parent, kj = parent[kept], kj[kept]
    fresh = centre[kept, None] + qrot(lib.sites[kj], spin[kept, None])
    placed = (x[:, :, None] + qrot(lib.sites[k], q[:, :, None])).reshape(len(x), -1, 3)[parent]
    real = (lib.label[k].reshape(len(k), -1) > 0)[parent]
    close = real[:, :, None] & (lib.label[kj] > 0)[:, None, :]
    for axis in range(lib.dim):
        close &= np.abs(placed[:, :, None, axis] - fresh[:, None, :, axis]) < FACE_TOLERANCE
    hit = np.where(close.any(axis=2), close.argmax(axis=2) + 1, 0)
    free = ~((hit > 0) & (partner[parent] > 0)).any(axis=1)
    return kept[free], hit[free]


def attach_batch(lib: SimpleNamespace, species: pa.Array, partner: pa.Array, wanted: pa.Array,
                 by_site: bool = False) -> pa.ListArray:
    """Per structure, the sterically possible attachments among ``wanted`` (slot, label) pairs.

    Every contact is listed with the face labels of its two sites, or ``by_site`` with their
    site labels.
    """
    names = lib.label if by_site else lib.color
    total, m = len(species), lib.stride
    counts = np.diff(wanted.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(counts)])
    pairs = wanted.flatten()
    all_slots = pairs.field("slot").to_numpy(zero_copy_only=False).astype(np.int64)
    all_labels = pairs.field("label").to_numpy(zero_copy_only=False).astype(np.int64)
    got = []                      # (row, candidate, hit width, hit values) pieces
    for rows, sp, pt in by_size(species, partner, m):
        k = sp.astype(np.int64) - 1
        x, q = poses(lib, sp, pt)
        parent = np.repeat(np.arange(len(rows)), counts[rows])
        which = (np.arange(len(parent)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
                 + starts[rows][parent])
        for lo in range(0, len(parent), CHUNK):
            part, cand = parent[lo:lo + CHUNK], which[lo:lo + CHUNK]
            kept, hit = contacts(lib, k, pt, x, q, part, all_slots[cand], all_labels[cand])
            got.append((rows[part[kept]], cand[kept], hit, names[k[part[kept]]].reshape(len(kept), -1)))
    row = np.concatenate([g[0] for g in got] or [np.zeros(0, np.int64)])
    cand = np.concatenate([g[1] for g in got] or [np.zeros(0, np.int64)])
    turn = np.argsort(cand, kind="stable") if len(got) > 1 else np.arange(len(row))
    rank = np.empty_like(turn)
    rank[turn] = np.arange(len(turn))
    base, hits, touch = 0, [], []
    kj = lib.species_of[all_labels[cand]]
    for _, _, hit, color in got:
        here = rank[base:base + len(hit)]
        hits.append((here, hit.astype(np.int16)))
        c, s = np.nonzero(hit)
        touch.append((here[c], s + 1, color[c, s], names[kj[base + c], hit[c, s] - 1]))
        base += len(hit)
    owner, t_slot, t_here, t_there = (np.concatenate([t[i] for t in touch] or [np.zeros(0, np.int64)]) for i in range(4))
    order = np.argsort(owner, kind="stable")
    ends = lambda n, at: np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32)
    small = lambda v: pa.array(v.astype(np.int16), type=pa.int16())
    touches = pa.ListArray.from_arrays(ends(len(row), owner), pa.StructArray.from_arrays(
        [small(t_slot[order]), small(t_here[order]), small(t_there[order])], ["slot", "here", "there"]))
    row, cand = row[turn], cand[turn]
    found = pa.StructArray.from_arrays(
        [small(all_slots[cand]), small(all_labels[cand]), small(lib.species_of[all_labels[cand]] + 1),
         list_column(hits, len(row), pa.int16()) if hits else pa.array([], pa.list_(pa.int16())), touches],
        ["slot", "label_j", "species_j", "hit", "touch"])
    return pa.ListArray.from_arrays(ends(total, row), found)


# -------------------------------------------------------------------- canonical form

def removable(partner: np.ndarray, n: int, stride: int) -> np.ndarray:
    """``[B, n]``: deleting this block leaves the others of its connected structure connected.

    One depth-first walk a row, all rows of the batch a step at a time: a block separates the others if some block
    found from it can't reach an earlier one without it, or if it is the start and more than one block was found from it.
    Steps are at most twice the blocks, so the work is linear in the bonds.
    """
    b, every = len(partner), np.arange(len(partner))
    other = np.where(partner > 0, (partner.astype(np.int64) - 1) // stride, -1).reshape(b, n, stride)
    found, low = np.full((b, n + 1), n, np.int32), np.full((b, n), n, np.int32)  # column n is where open sites lead
    parent, cut = np.full((b, n), -1), np.zeros((b, n), bool)
    at, from_start, clock = np.zeros(b, np.int64), np.zeros(b, np.int64), np.ones(b, np.int32)
    found[:, 0] = low[:, 0] = 0
    rows = every
    while len(rows):
        here = at[rows]
        near = other[rows, here]
        seen = found[rows[:, None], near]  # -1 is the last column
        fresh = (near >= 0) & (seen == n)
        down = fresh.any(1)
        r, v = rows[down], near[down, fresh[down].argmax(1)]
        parent[r, v], at[r] = here[down], v
        found[r, v] = low[r, v] = clock[r]
        clock[r] += 1
        r, u = rows[~down], here[~down]
        back = parent[r, u]
        low[r, u] = np.minimum(low[r, u], np.where(near[~down] == back[:, None], n, seen[~down]).min(1))
        up = back >= 0
        r, u, back = r[up], u[up], back[up]
        low[r, back] = np.minimum(low[r, back], low[r, u])
        cut[r, back] |= low[r, u] >= found[r, back]
        from_start[r] += back == 0
        at[r] = back
        rows = np.sort(np.concatenate([rows[down], r]))
    cut[:, 0] = from_start > 1
    if (clock != n).any():
        raise ValueError("a structure is not connected")
    return ~cut


def removable_batch(lib: SimpleNamespace, species: pa.Array, partner: pa.Array) -> pa.ListArray:
    parts = [(rows, removable(pt, sp.shape[1], lib.stride) if sp.shape[1] else np.zeros(sp.shape, bool))
             for rows, sp, pt in by_size(species, partner, lib.stride)]
    return list_column(parts, len(species), pa.bool_())


def root_candidates(lib: SimpleNamespace, species: np.ndarray, bound: np.ndarray):
    """Start frames ``(row, block, frame)`` in row order, thinned by an invariant choice.

    Only blocks of the rarest (species, bond pattern) kind can start a canonical walk; ties
    go to the smallest kind.  The pattern is the set of bound sites when all sites of the
    block are distinguishable, otherwise their number.
    """
    b, n = species.shape
    single = (lib.root_table >= 0).sum(axis=1) == 1
    mask = (bound.reshape(b, n, -1) * (1 << np.arange(lib.stride))).sum(axis=2)
    degree = bound.reshape(b, n, -1).sum(axis=2)
    k = species.astype(np.int64) - 1
    kind = (k << lib.stride) + np.where(single[k], mask, degree)
    rarity = (kind[:, :, None] == kind[:, None, :]).sum(axis=2)
    rank = rarity * (1 << (lib.stride + 16)) + kind
    chosen = rank == rank.min(axis=1, keepdims=True)
    row, block = np.nonzero(chosen)
    frames = lib.root_table[k[row, block]]
    pick, which = np.nonzero(frames >= 0)
    return row[pick], block[pick], frames[pick, which]


def walk(lib: SimpleNamespace, species: np.ndarray, partner: np.ndarray, row, block, frame):
    """Breadth-first relabelling from every start frame: ``rank, order, frames, code``."""
    n, m, roots = species.shape[1], lib.stride, len(row)
    r = np.arange(roots)
    sp, bonds = species[row].astype(np.int64) - 1, partner[row].astype(np.int64)
    rank, order = np.full((roots, n), -1), np.zeros((roots, n), np.int64)
    frames = np.zeros((roots, n), np.int64)
    code = np.zeros((roots, n * m), np.int64)
    rank[r, block], order[:, 0], frames[:, 0] = 0, block, frame
    found = np.ones(roots, np.int64)
    for i in range(n):
        here, f = order[:, i], frames[:, i]
        kh = sp[r, here]
        for j in range(m):
            s = lib.site_at[f, j]
            bond = np.where(s >= 0, bonds[r, here * m + s], 0)
            at = np.flatnonzero(bond > 0)
            if not len(at):
                continue
            q, t = np.divmod(bond[at] - 1, m)
            kq, sa = sp[at, q], s[at]
            fan = lib.fan_of[kq, t]
            pos, step = np.moveaxis(lib.entry[f[at], j, fan], -1, 0)
            vertex = lib.first[kq, t] + np.maximum(lib.pairing[lib.fan_of[kh[at], sa], fan, pos], 0)
            new = rank[at, q] < 0
            if new.any():
                an, qn = at[new], q[new]
                rank[an, qn] = found[an]
                order[an, found[an]] = qn
                frames[an, found[an]] = lib.frame_at[kq[new], vertex[new]]
                found[an] += 1
            rq = rank[at, q]
            seen_as = lib.canon_vertex[frames[at, rq], vertex]
            code[at, i * m + j] = 1 + (rq * lib.width + seen_as) * lib.fan + step
    return rank, order, frames, np.concatenate([np.take_along_axis(sp, order, 1) + 1, code], axis=1)


def smallest(code: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Mask of the rows that attain the lexicographic minimum of their group."""
    pad = -code.shape[1] % 3
    packed = np.pad(code, ((0, 0), (0, pad))).reshape(len(code), -1, 3)
    packed = (packed[..., 0] << 42) | (packed[..., 1] << 21) | packed[..., 2]
    alive = np.ones(len(code), bool)
    big = np.iinfo(np.int64).max
    for c in range(packed.shape[1]):
        value = np.where(alive, packed[:, c], big)
        alive &= value == np.minimum.reduceat(value, starts)[group]
    return alive


def canonical_batch(lib: SimpleNamespace, species: pa.Array, partner: pa.Array,
                    with_key: bool, with_search: bool) -> pa.StructArray:
    """Canonical arrays, symmetry number, and on request the exact key / reverse-search columns.

    ``accepted``: the last block of the input is the one the canonical parent lacks (up to
    symmetry).  ``orbit``: smallest slot equivalent to each slot under the automorphisms.
    """
    m, total = lib.stride, len(species)
    parts = {name: [] for name in ("species", "partner", "sigma", "key", "accepted", "orbit")}
    for rows, sp, pt in by_size(species, partner, m):
        b, n = sp.shape
        if n == 0:
            for name, values in (("species", sp), ("partner", pt), ("orbit", pt),
                                 ("sigma", np.ones(b, np.int64)), ("accepted", np.ones(b, bool)),
                                 ("key", np.zeros((b, 0), np.int64))):
                parts[name].append((rows, values))
            continue
        row, block, frame = root_candidates(lib, sp, pt > 0)
        rank, order, frames, code = walk(lib, sp, pt, row, block, frame)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        alive = smallest(code, starts, row)
        best = np.minimum.reduceat(np.where(alive, np.arange(len(row)), len(row)), starts)
        order0, rank0 = order[best], rank[best]
        bonds = np.take_along_axis(pt.reshape(b, n, m), order0[:, :, None], 1).reshape(b, n * m).astype(np.int64)
        host, t = np.divmod(bonds - 1, m)
        other = np.take_along_axis(rank0, np.maximum(host, 0), 1)
        frames0 = frames[best]
        if lib.fan == 1:  # sites are numbered in the walk's frames, so that the arrays say exactly what the code says
            t = lib.canon_site[np.take_along_axis(frames0, other, 1), np.maximum(t, 0)]
        moved = np.where(bonds > 0, other * m + t + 1, 0)
        if lib.fan == 1:
            at = lib.site_at[frames0]
            moved = np.where(at < 0, 0, np.take_along_axis(moved.reshape(b, n, m), np.maximum(at, 0), 2)).reshape(b, n * m)
        parts["species"].append((rows, np.take_along_axis(sp, order0, 1)))
        parts["partner"].append((rows, moved.astype(np.int16)))
        parts["sigma"].append((rows, np.add.reduceat(alive.astype(np.int64), starts)))
        if with_key:
            parts["key"].append((rows, code[best].astype(">u4")))
        if with_search:
            # the block a breadth-first walk finds last never separates the others
            parts["accepted"].append((rows, np.logical_or.reduceat(alive & (order[:, -1] == n - 1), starts)))
            image = np.take_along_axis(rank0[row], order, 1)
            if lib.fan == 1:
                site = lib.canon_site[np.take_along_axis(frames0[row], image, 1)[:, :, None], np.maximum(lib.site_at[frames], 0)]
            else:
                site = lib.site_at[frames[:, :, None], lib.canon_site[frames0[row]]]
            slot = np.where(alive[:, None], (image[:, :, None] * m + site + 1).reshape(len(row), -1), n * m + 1)
            parts["orbit"].append((rows, np.minimum.reduceat(slot, starts).astype(np.int16)))
    columns = {"species": list_column(parts["species"], total, pa.int16()),
               "partner": list_column(parts["partner"], total, pa.int16()),
               "sigma": scalar_column(parts["sigma"], total, pa.int64())}
    if with_key:
        columns["key"] = binary_column(parts["key"], total)
    if with_search:
        columns["accepted"] = scalar_column(parts["accepted"], total, pa.bool_())
        columns["orbit"] = list_column(parts["orbit"], total, pa.int16())
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))
