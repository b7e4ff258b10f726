"""A small causal self-attention model over subword symbols, in numpy.

Symbols are the most frequent subword ids of all training documents, one for the end of a text (which also
opens it) and one for all other ids. The next symbol's probability is a product of two softmaxes, over
groups of 32 symbols and over the group's 32, so a step costs 64 exponentials instead of 1024.
"""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE = 24, 12
WIDTH, HIDDEN, SIDE = 16, 32, 32
SYMBOLS = SIDE * SIDE
END, OTHER = 0, 1
#: Windows whose gradients are found at a time, so that their arrays stay in the cache.
PART = 96
#: Rows multiplied at a time.
BLOCK = 192

Params = dict[str, np.ndarray]


def fresh(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    shape = {
        "emb": (SYMBOLS, WIDTH), "pos": (WINDOW, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "mix": (WIDTH, WIDTH), "up": (WIDTH, HIDDEN), "up0": (HIDDEN,),
        "down": (HIDDEN, WIDTH), "group": (WIDTH, SIDE), "group0": (SIDE,), "inner": (WIDTH, SIDE), "inner0": (SIDE, SIDE),
    }
    return {k: (rng.standard_normal(s) * (0.0 if k.endswith("0") else 0.3 if k == "emb" else 0.25 if len(s) == 2 and k != "pos" else 0.1)).astype(np.float32) for k, s in shape.items()}


MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), dtype=bool)), np.float32(0), np.float32(-1e9))


#: Sums a row of SIDE; a row of it for each group.
ONES, GROUPS = np.ones(SIDE, dtype=np.float32), np.eye(SIDE, dtype=np.float32)
SCALE = np.float32(WIDTH**-0.5)


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def keep_memory() -> None:
    """Has this process keep freed memory for its next arrays.

    glibc gives back, and gets zeroed page by page again, what is larger than any array freed before (32 MB at most).
    """
    np.empty(31 << 20, dtype=np.uint8)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a [n, k] @ b [k, m] by BLOCK rows, which for so few columns takes less time than one call (OpenBLAS likely packs larger arrays first)."""
    n, b = len(a), np.ascontiguousarray(b)
    whole = n - n % BLOCK
    out = np.empty((n, b.shape[1]), dtype=a.dtype)
    np.matmul(a[:whole].reshape(-1, BLOCK, a.shape[1]), b, out=out[:whole].reshape(-1, BLOCK, b.shape[1]))
    if whole < n:
        np.matmul(a[whole:], b, out=out[whole:])
    return out


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a [n, k].T @ b [n, m], by BLOCK rows too."""
    whole = len(a) - len(a) % BLOCK
    out = (a[:whole].reshape(-1, BLOCK, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, BLOCK, b.shape[1])).sum(axis=0)
    return out + a[whole:].T @ b[whole:] if whole < len(a) else out


def projections(p: Params) -> tuple[np.ndarray, ...]:
    """What gives queries, with their scale, keys and values."""
    q, k, v = (p["qkv"][:, at : at + WIDTH] for at in range(0, 3 * WIDTH, WIDTH))
    return q * SCALE, k, v


def good(sums: np.ndarray) -> bool:
    """Whether exponentials without a shift gave these sums: neither overflow nor nothing but zeros."""
    return bool(np.isfinite(sums).all() and sums.all())


def states(p: Params, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Hidden states [batch, WINDOW, WIDTH] of symbols x [batch, WINDOW]; each sees only itself and what precedes."""
    n = len(x)
    x0 = np.take(p["emb"], x, axis=0)
    x0 += p["pos"]
    q, k, v = ((x0.reshape(-1, WIDTH) @ m).reshape(n, WINDOW, WIDTH) for m in projections(p))
    a = q @ k.transpose(0, 2, 1)
    a += MASK
    np.exp(a, out=a)
    sums = (a.reshape(-1, WINDOW) @ ONES[:WINDOW]).reshape(n, WINDOW, 1)
    if not good(sums):  # scores far from what training leaves
        a = softmax(q @ k.transpose(0, 2, 1) + MASK)
        sums = np.ones_like(sums)
    r = 1 / sums
    o = a @ v
    o *= r
    h = o.reshape(-1, WIDTH) @ p["mix"]
    h += x0.reshape(-1, WIDTH)
    u = product(h, p["up"])
    u += p["up0"]
    np.maximum(u, 0, out=u)
    out = product(u, p["down"])
    out += h
    if keep is not None:
        keep.update(x0=x0, q=q, k=k, v=v, a=a, r=r, o=o, h=h, u=u)
    return out.reshape(n, WINDOW, WIDTH)


def logits(p: Params, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the groups after the states h [n, WIDTH], and of the symbols of the groups g [n]."""
    a, b = product(h, p["group"]), product(h, p["inner"])
    a += p["group0"]
    b += np.take(p["inner0"], g, axis=0)
    return a, b


def log_probs(p: Params, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each symbol y [n] after the state h [n, WIDTH]."""
    g, i = y >> 5, y & 31
    a, b = logits(p, h, g)
    at = np.arange(0, len(y) * SIDE, SIDE)
    out = np.take(a, at + g) + np.take(b, at + i)
    np.exp(a, out=a)
    np.exp(b, out=b)
    out -= np.log((a @ ONES) * (b @ ONES))
    if not np.isfinite(out).all():  # logits far from what training leaves: once more, shifted
        a, b = (z.astype(np.float64) for z in logits(p, h, g))
        top = lambda m: m.max(axis=1) + np.log(np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1))
        out = np.take(a, at + g) + np.take(b, at + i) - top(a) - top(b)
    return out


def gradients(p: Params, x: np.ndarray, y: np.ndarray, w: np.ndarray, need_loss: bool = True) -> tuple[float, Params]:
    """Mean loss over the targets y [batch, WINDOW] of weight w, unless not needed, and its gradients."""
    s: dict = {}
    n = len(x)
    f = states(p, x, s).reshape(-1, WIDTH)
    yy, ww = y.reshape(-1), (w / w.sum()).reshape(-1).astype(np.float32)
    g, i = yy >> 5, yy & 31
    at = np.arange(0, len(yy) * SIDE, SIDE)
    d: Params = {}
    loss, df = 0.0, np.zeros_like(f)
    for name, c, own in zip(("group", "inner"), logits(p, f, g), (g, i), strict=True):
        np.exp(c, out=c)
        sums = c @ ONES
        if not good(sums):
            c = softmax(logits(p, f, g)[name == "inner"])
            sums = np.ones_like(sums)
        flat = c.reshape(-1)
        if need_loss:
            loss -= float((ww * np.log(flat[at + own] / sums + 1e-12)).sum())
        c *= (ww / sums)[:, None]
        flat[at + own] -= ww
        d[name] = cross(f, c)
        d[name + "0"] = ONES[:1].repeat(len(c)) @ c if name == "group" else cross(np.take(GROUPS, g, axis=0), c)
        df += product(c, p[name].T)
    d["down"] = cross(s["u"], df)
    du = product(df, p["down"].T)
    du *= s["u"] > 0
    d["up"], d["up0"] = cross(s["h"], du), ONES[:1].repeat(len(du)) @ du
    dh = product(du, p["up"].T)
    dh += df
    d["mix"] = s["o"].reshape(-1, WIDTH).T @ dh
    do = (dh @ p["mix"].T).reshape(n, WINDOW, WIDTH)
    do *= s["r"]
    # a holds the weights without r, which do has now
    ds = do @ s["v"].transpose(0, 2, 1)
    ds -= np.einsum("nid,nid->ni", do, s["o"])[..., None]  # the sum of ds by weight
    ds *= s["a"]
    dqkv = np.empty((n, WINDOW, 3 * WIDTH), dtype=ds.dtype)
    np.matmul(ds, s["k"], out=dqkv[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), s["q"], out=dqkv[..., WIDTH : 2 * WIDTH])
    np.matmul(s["a"].transpose(0, 2, 1), do, out=dqkv[..., 2 * WIDTH :])
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    d["qkv"] = cross(s["x0"].reshape(-1, WIDTH), dqkv)
    d["qkv"][:, :WIDTH] *= SCALE
    dx = product(dqkv, np.concatenate(projections(p), axis=1).T)
    dx += dh
    d["pos"] = dx.reshape(n, WINDOW, WIDTH).sum(0)
    d["emb"] = np.zeros_like(p["emb"])
    order = np.argsort(x.astype(np.int16), axis=None, kind="stable")  # by radix
    own = x.reshape(-1)[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    d["emb"][own[first]] = np.add.reduceat(np.take(dx, order, axis=0), first)
    return loss, d


def windows(text: np.ndarray, again: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and whether a window scores its target, [n, WINDOW] each, of one text's symbols.

    The text ends with END; each of its symbols is scored once, by a window that holds at least
    WINDOW - STRIDE symbols before it or the text's start; with ``again`` by every window that holds it.
    """
    return all_windows([text], again)[:3]


def all_windows(texts: list[np.ndarray], again: bool = False, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``windows`` of one text after the other, each ``stride`` symbols on, and whether a window is the first of its text."""
    each = np.array([len(t) for t in texts])
    count = 1 + np.maximum(0, -(-(each - WINDOW) // stride))
    room = (count - 1) * stride + WINDOW + 1
    begin = np.cumsum(room) - room
    padded = np.full(room.sum(), END, dtype=np.int64)
    padded[np.arange(each.sum()) + np.repeat(begin + 1 - (np.cumsum(each) - each), each)] = np.concatenate(texts)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    at = np.repeat(begin, count) + number * stride
    scored = np.arange(WINDOW) < (np.repeat(each, count) - number * stride)[:, None]
    if not again:
        scored[number > 0, : WINDOW - stride] = False
    return rows[at], rows[at + 1], scored, number == 0


def train(texts: list[np.ndarray], steps: int = 900, batch: int = 192, seed: int = 7) -> Params:
    """Adam over windows drawn at random from the texts."""
    p = fresh(seed)
    if not texts:
        return p
    keep_memory()
    x, y, w = (np.concatenate(z) for z in zip(*(windows(t, True) for t in texts), strict=True))
    counts = np.bincount(y[w], minlength=SYMBOLS).astype(np.float32) + 0.5
    groups = counts.reshape(SIDE, SIDE)
    p["group0"] = np.log(groups.sum(1) / groups.sum()).astype(np.float32)
    p["inner0"] = np.log(groups / groups.sum(1, keepdims=True)).astype(np.float32)
    rng = np.random.default_rng(seed)
    adam = Adam(p)
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        adam.step(x[pick], y[pick], w[pick], 0.02 * min(1, t / 50) * (0.05 + 0.95 * (1 - t / steps)))
    return p


class Adam:
    """Changes ``p`` in place; its arrays become parts of one."""

    def __init__(self, p: Params):
        self.flat = pack(p)
        self.p, self.t = p, 0
        p.update(views(self.flat, p))
        self.moments = np.zeros((2, len(self.flat)), dtype=self.flat.dtype)
        self.m = views(self.moments[0], p)

    def step(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float) -> None:
        self.t += 1
        w = w.astype(np.float32)
        d = np.zeros_like(self.flat)
        for at in range(0, len(x), PART):
            part = slice(at, at + PART)
            if own := w[part].sum():
                d += np.float32(own / w.sum()) * pack(gradients(self.p, x[part], y[part], w[part], False)[1])
        m, v = self.moments
        m += np.float32(0.1) * (d - m)
        v += np.float32(0.01) * (d * d - v)
        self.flat -= np.float32(rate / (1 - 0.9**self.t)) * m / (np.sqrt(v / np.float32(1 - 0.99**self.t)) + np.float32(1e-8))


def views(flat: np.ndarray, like: Params) -> Params:
    """The parts of ``flat`` in the order of ``pack``."""
    cuts = np.cumsum([like[k].size for k in sorted(like)])[:-1]
    return {k: z.reshape(like[k].shape) for k, z in zip(sorted(like), np.split(flat, cuts), strict=True)}


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def unpack(flat: np.ndarray) -> Params:
    return {k: z.astype(np.float32) for k, z in views(flat, fresh()).items()}


def tables(p: Params) -> tuple[np.ndarray, ...]:
    """Rows of each symbol: its query beside its embedding, and its key beside its mixed value; then what each place adds to them.

    The layer is linear up to here, so the sums are the rows of a symbol at a place, and the tables stay small.
    """

    def rows(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, k, v = np.split(own @ p["qkv"], 3, axis=1)
        return np.concatenate([q * np.float32(WIDTH**-0.5), own], axis=1), np.concatenate([k, v @ p["mix"]], axis=1)

    return *rows(p["emb"]), *rows(p["pos"])


def last_states(p: Params, own: tuple[np.ndarray, ...], x: np.ndarray, start: int) -> np.ndarray:
    """``states`` of the places from ``start`` on: with one layer, the places before are needed as keys and values only."""
    late, early, late_place, early_place = own
    qe, kv = np.take(late, x[:, start:], axis=0), np.take(early, x, axis=0)
    qe += late_place[start:]
    kv += early_place
    a = qe[..., :WIDTH] @ kv[..., :WIDTH].transpose(0, 2, 1)
    a += MASK[start:]
    np.exp(a, out=a)
    h = a @ kv[..., WIDTH:]
    with np.errstate(all="ignore"):
        h *= (1 / (a.reshape(-1, WINDOW) @ ONES[:WINDOW])).reshape(len(x), -1, 1)
    h += qe[..., WIDTH:]
    if not np.isfinite(h).all():  # scores far from what training leaves
        return states(p, x, {})[:, start:]
    h = h.reshape(-1, WIDTH)
    u = product(h, p["up"])
    u += p["up0"]
    h += product(np.maximum(u, 0, out=u), p["down"])
    return h.reshape(len(x), -1, WIDTH)


def symbol_scores(p: Params, texts: list[np.ndarray], most: int = 192) -> list[np.ndarray]:
    """Natural log probability of each symbol of each text, windows of many texts batched together."""
    if not texts:
        return []
    x, y, w, first = all_windows(texts)
    many = w.sum(axis=1)
    begin = np.cumsum(many) - many
    out = np.zeros(int(many.sum()))
    own = tables(p)
    full = many == np.where(first, WINDOW, STRIDE)  # windows whose places from start on are all scored
    for which, start in ((first & full, 0), (first & ~full, 0), (~first & full, WINDOW - STRIDE), (~first & ~full, WINDOW - STRIDE)):
        which = np.flatnonzero(which)
        for at in range(0, len(which), most):
            part = which[at : at + most]
            h, to, places = last_states(p, own, x[part], start), y[part, start:], begin[part, None] + np.arange(WINDOW - start)
            if full[part[0]]:
                out[places] = log_probs(p, h.reshape(-1, WIDTH), to.reshape(-1)).reshape(to.shape)
            else:
                take = w[part, start:]
                out[places[take]] = log_probs(p, h[take], to[take])
    return np.split(out, np.cumsum([len(t) for t in texts[:-1]]))


def score(p: Params, texts: list[np.ndarray], most: int = 192) -> list[float]:
    """Natural log probability of each text."""
    return [float(z.sum()) for z in symbol_scores(p, texts, most)]
