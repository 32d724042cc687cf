"""The window joins step by step, in plain Python, written from their descriptions and not from the closed forms."""

from __future__ import annotations

from collections import deque


def eager(r, s, window, prefill=None):
    """r, s: lists of (ts, key). Returns (r position, s position) pairs."""
    (wr, ws), (pr, ps) = window, prefill or window
    in_r, in_s = deque(range(pr), maxlen=wr), deque(range(ps), maxlen=ws)
    i, j, out = pr, ps, []
    while i < len(r) or j < len(s):
        if j == len(s) or (i < len(r) and r[i][0] < s[j][0]):
            in_r.append(i)
            out += [(i, x) for x in in_s if r[i][1] is not None and s[x][1] == r[i][1]]
            i += 1
        else:
            in_s.append(j)
            out += [(x, j) for x in in_r if s[j][1] is not None and r[x][1] == s[j][1]]
            j += 1
    return out


def by_batch(r, s, window, batch, mode):
    """Returns (k, r position, s position) triples."""
    (wr, ws), (br, bs) = window, batch
    old_r, old_s = list(range(wr)), list(range(ws))
    i, j, k, out = wr, ws, 0, []
    while i < len(r) or j < len(s):
        new_r, new_s = list(range(i, min(i + br, len(r)))), list(range(j, min(j + bs, len(s))))
        i, j = i + len(new_r), j + len(new_s)
        pairs = [(a, b) for a in old_r + new_r for b in old_s + new_s if r[a][1] is not None and r[a][1] == s[b][1]]
        fresh_r, fresh_s = {r[a][1] for a in new_r}, {s[b][1] for b in new_s}
        for a, b in pairs:
            a_new, b_new = a in new_r, b in new_s
            if mode == "delta":
                keep = a_new or b_new
            elif mode == "rect":
                keep = (a_new or r[a][1] in fresh_s) and (b_new or r[a][1] in fresh_r)
            else:
                keep = True
            if keep:
                out.append((k, a, b))
        old_r, old_s = (old_r + new_r)[-wr:], (old_s + new_s)[-ws:]
        k += 1
    return out
