"""The kernel of local moves over arrays of links, for graphs whose nodes have many neighbours each.

It makes the same moves as ``localmove.move_nodes`` does over neighbour maps, node by node in the same order.  Nodes that stay
are found many at a time: the next ones of a sweep are all judged by the clusters as they are, those before the first that
moves stay, that one moves, and the sweep goes on behind it.

While many nodes of a large level move, one in ``ALONG`` is judged together and all of those that gain move at once, as in parallel
local moving; levels of fewer than ``ALONG`` x 4 nodes have no such sweeps, and the last sweeps of any level go node by node."""

from __future__ import annotations

import numpy as np

#: Cells of nodes by clusters that are judged together at most.
CELLS = 8_000_000
#: Nodes that are judged together at most.
BLOCK = 1024
#: Nodes of a level for each that moves along with others.
ALONG = 500
#: Part of the nodes that moved in a sweep, above which the next has nodes move together.
MANY_MOVES = 0.02
#: Sweeps of a level in which nodes move together at most, as moves judged together may undo each other.
TOGETHER = 40


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.maximum(x, 1e-300)) * (x > 0)


def visiting_order(n: int, seed: int) -> list[int]:
    """The seeded order in which a sweep visits n nodes."""
    return sorted(range(n), key=lambda i: hash((seed * 1_000_003 + i) * 2_654_435_761 % 2**32))


def move_arrays(a: np.ndarray, b: np.ndarray, w: np.ndarray, loops: np.ndarray, sizes: np.ndarray, model: str, gamma: float, m: float, seed: int, start: np.ndarray | None = None, bounds: np.ndarray | None = None, elsewhere: float = 0.0) -> np.ndarray:
    """Cluster of each node over weighted pairs (a, b, w), each once; the other arguments as of ``localmove.move_nodes``."""
    n = len(sizes)
    order = np.array(visiting_order(n, seed), np.int64)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    reach = (np.bincount(a, w, n) + np.bincount(b, w, n))[order]
    x, y = place[a], place[b]  # from here on a node is its place in the order
    ends = np.concatenate([x, y])
    at = np.argsort(ends, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    near = np.concatenate([y, x])[at]
    del ends
    weight = None if len(w) and (w == 1.0).all() else w[at % max(1, len(a))]
    del at
    # clusters are numbered anew without gaps; that keeps their order, by which ties fall
    names, label = np.unique(order if start is None else np.asarray(start)[order], return_inverse=True)
    label = label.astype(np.int32)
    count = len(names)
    degree, size_of = reach + 2 * loops[order], np.asarray(sizes)[order]
    apart = label[x] != label[y]
    out_w = w[apart]
    outside = np.bincount(label[x[apart]], out_w, count) + np.bincount(label[y[apart]], out_w, count)
    del x, y, apart, out_w
    if bounds is not None:
        group = np.asarray(bounds)[order]
        here = np.repeat(group, np.diff(first)) == group[near]
        first = np.concatenate([[0], np.cumsum(here)])[first]
        near, weight = near[here], None if weight is None else weight[here]
    all_out, double = float(outside.sum()) + elsewhere, 2 * m
    map_equation, cpm = model == "infomap", model == "cpm"
    factor = gamma if cpm else gamma / double
    visited = np.flatnonzero(np.diff(first))
    lows, highs = first[visited], first[visited + 1]
    lengths, visited_list = highs - lows, visited.tolist()
    low_list, high_list = lows.tolist(), highs.tolist()
    degrees, counts, reaches = degree.tolist(), size_of.tolist(), reach.tolist()

    def cost(out, vol):
        return -2 * _plogp(out / double) + _plogp((out + vol) / double)

    joint, sweeps, moves = n // ALONG, 0, n
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(first)) if map_equation and joint >= 4 and bounds is None else None
    asked = np.ones(n, bool)  # a neighbour moved since, or not asked yet
    run = 1.0  # nodes that stayed before one that moved, lately
    while True:
        used, label = np.unique(label, return_inverse=True)
        label, names, count = label.astype(np.int32), names[used], len(used)
        outside = outside[used]
        total, size, members = np.bincount(label, degree, count), np.bincount(label, size_of, count), np.bincount(label, minlength=count)
        held = np.zeros(count)
        volume = size if cpm else total
        most = max(1, min(BLOCK, CELLS // max(1, count)))
        wide = None
        together = bounds is None and joint >= 4 and sweeps < TOGETHER and moves > MANY_MOVES * n
        if owner is not None and sweeps <= TOGETHER:  # nodes that moved at once may be neighbours
            cut = label[owner] != label[near]
            outside = np.bincount(label[owner[cut]], None if weight is None else weight[cut], count).astype(float)
            all_out = float(outside.sum()) + elsewhere
            del cut
        sweeps, moves = sweeps + 1, 0
        here = np.flatnonzero(asked[visited])
        visit, low_of, high_of, length_of = visited[here], lows[here], highs[here], lengths[here]
        visited_list, low_list, high_list = visit.tolist(), low_of.tolist(), high_of.tolist()
        whole = len(here) == len(visited)
        k, end = 0, len(visited_list)
        while k < end:
            # how many to judge together
            block = min(most, end - k, joint if together else int(1.5 * run) + 1)
            if (block >= 4 or together) and bounds is None:
                who = visit[k : k + block]
                size_here = length_of[k : k + block]
                starts = np.cumsum(size_here) - size_here
                s, e = low_list[k], high_list[k + block - 1]
                span = slice(s, e) if whole else np.repeat(low_of[k : k + block] - starts, size_here) + np.arange(size_here.sum())
                own = label[who]
                lab = label[near[span]]
                unit = size_of[who] if cpm else degree[who]
                if 2 * count <= len(lab) / block and not map_equation:
                    cells = np.bincount(np.repeat(np.arange(0, block * count, count), size_here) + lab, None if weight is None else weight[span], block * count).reshape(block, count)
                    mine = cells[np.arange(block), own]
                    gains = cells - (factor * unit)[:, None] * volume
                    gains[cells == 0] = -np.inf
                    rows = np.arange(block)
                    stay = mine - factor * unit * (volume[own] - unit)
                    gains[rows, own] = np.where(mine > 0, stay, -np.inf)
                    top = gains.max(axis=1)
                    leaves = top > stay + 1e-12
                else:
                    if wide is None:
                        wide = np.zeros(most * count)
                    row = np.repeat(np.arange(block), size_here)
                    key = row * count + lab
                    np.add.at(wide, key, 1.0 if weight is None else weight[span])
                    to, mine = wide[key], wide[np.arange(block) * count + own]
                    wide[key] = 0.0
                    if map_equation:
                        reach_here, degree_here = reach[who], degree[who]
                        own_out = outside[own] - reach_here + 2 * mine
                        base = all_out - outside[own] + own_out
                        old = cost(outside, total)
                        out = outside[lab] + reach_here[row] - 2 * to
                        gains = -(_plogp((base[row] - outside[lab] + out) / double) + cost(out, total[lab] + degree_here[row]) - old[lab])
                        gains[lab == own[row]] = -np.inf
                        total_own = total[own] - degree_here
                        back = own_out + reach_here - 2 * mine
                        stay = -(_plogp((base - own_out + back) / double) + cost(back, total_own + degree_here) - cost(own_out, total_own))
                    else:
                        one = factor * unit
                        gains = to - one[row] * volume[lab]
                        gains[lab == own[row]] = -np.inf
                        stay = mine - one * (volume[own] - unit)
                    top = np.maximum.reduceat(gains, starts)
                    leaves = top > stay + 1e-12
                    cells = None
                asked[who] = False
                if together:
                    if leaves.any():
                        if cells is not None:
                            to_label = gains[leaves].argmax(axis=1)
                        else:
                            to_label = np.minimum.reduceat(np.where(gains == top[row], lab, count), starts)[leaves]
                        going, left_label = who[leaves], own[leaves]
                        if map_equation:
                            to_best = np.maximum.reduceat(np.where((gains == top[row]) & (lab == np.repeat(np.minimum.reduceat(np.where(gains == top[row], lab, count), starts), size_here)), to, -np.inf), starts)[leaves]
                            np.add.at(outside, left_label, 2 * mine[leaves] - reach[going])
                            np.add.at(outside, to_label, reach[going] - 2 * to_best)
                            all_out += float((2 * mine[leaves] - 2 * to_best).sum())
                        for sums, part in ((total, degree[going]), (size, size_of[going]), (members, np.ones(len(going), np.int64))):
                            np.subtract.at(sums, left_label, part)
                            np.add.at(sums, to_label, part)
                        label[going] = to_label
                        moves += len(going)
                        mine_moved = leaves[np.repeat(np.arange(block), size_here)]
                        beside = near[span][mine_moved]
                        asked[beside[label[beside] != np.repeat(to_label, size_here[leaves])]] = True
                    k += block
                    continue
                go = int(leaves.argmax())
                if leaves[go]:
                    asked[who[go + 1 :]] = True  # judged anew behind the one that moves
                if not leaves[go]:
                    k += block
                    run = min(2.0 * run + 1, float(most))
                    continue
                run = 0.75 * run + 0.25 * go
                k += go
            i = visited_list[k]
            low, high = low_list[k], high_list[k]
            k += 1
            own = int(label[i])
            asked[i] = False
            if bounds is not None and members[own] > 1:
                continue
            at = label[near[low:high]]
            np.add.at(held, at, 1.0 if weight is None else weight[low:high])
            to = held[at]
            mine = float(held[own])
            held[at] = 0.0
            total[own] -= degrees[i]
            size[own] -= counts[i]
            if map_equation:
                left, own_out = outside[own], outside[own] - reaches[i] + 2 * mine
                base = all_out - left + own_out
                cands = np.append(at, own)
                rest = outside[cands]
                stays = cands == own
                rest[stays] = own_out
                out = rest + reaches[i] - 2 * np.append(to, mine)
                vol = total[cands]
                gains = -(_plogp((base - rest + out) / double) + cost(out, vol + degrees[i]) - cost(rest, vol))
                stay, gains, stays = gains[-1], gains[:-1], stays[:-1]
            else:
                one = factor * (counts[i] if cpm else degrees[i])
                gains = to - one * volume[at]
                stay = mine - one * volume[own]
            top = gains.max()
            best = own
            if top > stay + 1e-12:
                best = int(at[gains == top].min())
            if map_equation:
                mine_there = to[int((at == best).argmax())] if best != own else mine
                outside[own] = own_out
                new = outside[best] + reaches[i] - 2 * mine_there
                all_out += own_out - left + new - outside[best]
                outside[best] = new
            total[best] += degrees[i]
            size[best] += counts[i]
            if best != own:
                members[own] -= 1
                members[best] += 1
                label[i] = best
                moves += 1
                beside = near[low:high]
                asked[beside[label[beside] != best]] = True
            elif block < 4:
                run += 0.25
            if best != own and block < 4:
                run *= 0.75
        if bounds is not None or not (moves and asked[visited].any()):
            return names[label[place]]
