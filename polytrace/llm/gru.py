"""A gated recurrent language model in numpy: class-factored output, truncated backpropagation, carried state.

Symbols are numbered by falling frequency; symbol 0 is the end of a document and also what a document
starts from. P(symbol | past) = P(class | state) P(symbol | class, state), with ``CLASS`` symbols in
each class, so a step costs the square root of the vocabulary.

Documents run in parallel lanes. A lane holds whole documents one after another; windows of some steps move down all lanes,
the state goes over from window to window and is cleared where a document starts, so every symbol is
predicted from its whole document. Gradients stop at window edges.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASS = 32, 64
#: Rows whose logits are worked on at once, so that they stay near the processor. Up to a million of rows * HIDDEN * CLASS the library
#: multiplies without packing its operands first, which takes little over half the time.
BLOCK = 480
#: The gradients of a symbol met so often in a window are added up by a product of their own.
OFTEN = 24
#: Steps of a window that are worked on at once on the way back.
PART = 4


class GRU:
    """Weights in one flat array ``p``, with named views into it."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5, flat: np.ndarray | None = None):
        self.classes, self.hidden, self.size = classes, hidden, classes * CLASS
        shapes = {"e": (self.size, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (hidden, classes), "bc": (classes,), "wo": (classes, hidden, CLASS), "bo": (classes, CLASS)}
        n = sum(int(np.prod(s)) for s in shapes.values())
        self.p = np.zeros(n, np.float32) if flat is None else flat
        self.rooms: dict[str, np.ndarray] = {}
        self.at, at = {}, 0
        for name, shape in shapes.items():
            self.at[name] = (at, at + int(np.prod(shape)), shape)
            at += int(np.prod(shape))
        if flat is None:
            rng = np.random.default_rng(seed)
            self["e"][:] = rng.normal(0, 0.3, shapes["e"])
            self["e"][:, :hidden] += 1.0  # start out by keeping the state
            self["u"][:] = rng.normal(0, 0.7 / np.sqrt(hidden), shapes["u"])
            self["wc"][:] = rng.normal(0, 0.02, shapes["wc"])
            self["wo"][:] = rng.normal(0, 0.02, shapes["wo"])

    def __getitem__(self, name: str) -> np.ndarray:
        a, b, shape = self.at[name]
        return self.p[a:b].reshape(shape)

    def room(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        """An array to write on, which the next call of that name takes again: fresh memory for each window would cost more than some of the passes over it."""
        n, had = int(np.prod(shape)), self.rooms.get(name)
        if had is None or had.size < n or had.dtype != dtype:
            had = self.rooms[name] = np.empty(n, dtype)
        return had[:n].reshape(shape)

    def start_from(self, frequency: np.ndarray) -> None:
        """Biases that give the symbols' overall frequencies."""
        f = np.maximum(frequency.astype(np.float64), 0.5).reshape(self.classes, CLASS)
        mass = f.sum(axis=1)
        self["bc"][:] = np.log(mass / mass.sum())
        self["bo"][:] = np.log(f / mass[:, None])

    def forward(self, x: np.ndarray, h: np.ndarray, keep: np.ndarray, taped: bool = False) -> tuple[np.ndarray, tuple]:
        """States after each step of a window: x and keep are steps x lanes; keep 0 clears the state first. The tape, good until the next taped call, holds, by steps, the states before, the gates, the candidates and half of what the reset gate scaled.

        Each gate has an array of its own, so that passes run over whole arrays; the logistic function is taken by tanh() of half its argument, which is faster than exp() and needs fewer passes.
        """
        hid, (steps, lanes) = self.hidden, x.shape
        u = np.ascontiguousarray(self["u"].reshape(hid, 3, hid).swapaxes(0, 1))
        u[2] *= 0.5  # as the reset gate is doubled below
        e, rows = self["e"].reshape(-1, hid), x[:, None, :].astype(np.intp) * 3 + np.arange(3)[:, None]
        out, on = np.empty((steps, lanes, hid), u.dtype), keep.all(axis=1).tolist()
        g, length = np.empty((3, lanes, hid), u.dtype), steps if taped else 1
        before, ns = (self.room(name, (length, lanes, hid), u.dtype) for name in ("before", "ns"))
        gates = self.room("gates", (length, 3, lanes, hid), u.dtype)
        for t in range(steps):
            if not on[t]:
                h = h * keep[t][:, None]
            at = t if taped else 0
            r, n, new = gates[at], ns[at], out[t]
            zr = r[:2]
            e.take(rows[t], axis=0, out=g, mode="clip")
            np.matmul(h, u, out=r)
            zr += g[:2]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            np.multiply(zr[1], r[2], out=n)
            n += g[2]
            np.tanh(n, out=n)
            if taped:
                zr *= 0.5
                before[t] = h
            else:
                zr[0] *= 0.5
            np.subtract(h, n, out=new)
            new *= zr[0]
            new += n
            h = new
        return out, (before, gates, ns)

    def output(self, h: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of symbols y after states h; with ``grads``, also d loss / d h, and the weights' gradients are added there.

        States lie in [-1, 1], so a logit can't exceed its weights' absolute sum; only a model near the range of exp() needs more care.
        Biases enter as factors of the exponentials, in the products that follow, not as a pass over all logits.
        """
        wc, wo, bc, bo = self["wc"], self["wo"], self["bc"], self["bo"]
        order = np.argsort((y // CLASS).astype(np.int16), kind="stable")
        ys, n = y.astype(np.intp).take(order), len(y)
        c = ys // CLASS
        word, bounds = ys - c * CLASS, np.searchsorted(c, np.arange(self.classes + 1))
        hs = h.take(order, axis=0, out=self.room("hs", h.shape, h.dtype), mode="clip")
        wide = self.room("logits", (BLOCK * max(CLASS, self.classes),), h.dtype)
        places, ones = {k: np.arange(BLOCK) * k for k in (CLASS, self.classes)}, np.ones(BLOCK, h.dtype)
        lp, total = self.room("lp", (2, n), h.dtype), self.room("total", (2, n), h.dtype)
        dh = None if grads is None else self.room("dh", (2, *h.shape), h.dtype)

        def softmax(which: int, first: int, end: int, weight: np.ndarray, factor: np.ndarray, own: np.ndarray, less: np.ndarray | None, back: np.ndarray | None, gw: np.ndarray | None, gb: np.ndarray | None) -> None:
            """One factor of the probabilities of some rows: ``own`` are the columns of their own logits, ``less`` what a hit takes off there, ``back`` the weights times the factors, transposed."""
            for a in range(first, end, BLOCK):
                b = min(a + BLOCK, end)
                hk, flat, inner = hs[a:b], wide[: (b - a) * len(factor)], total[which, a:b]
                logits, at = flat.reshape(b - a, -1), places[len(factor)][: b - a] + own[a:b]
                np.matmul(hk, weight, out=logits)
                flat.take(at, out=lp[which, a:b], mode="clip")
                np.exp(logits, out=logits)
                np.matmul(logits, factor, out=inner)
                if gw is not None:
                    logits *= np.reciprocal(inner)[:, None]
                    flat[at] -= less[a:b]
                    np.matmul(logits, back, out=dh[which, a:b])
                    if a == first:
                        np.matmul(hk.T, logits, out=gw)
                        np.matmul(ones[: b - a], logits, out=gb)
                    else:
                        gw += hk.T @ logits
                        gb += ones[: b - a] @ logits

        fc, fo = np.exp(bc), np.exp(bo)
        less_class, less_word, bwc, bwo, gwc, gbc, gwo, gbo = [None] * 8
        if grads is not None:
            less_class, less_word = (1 / fc)[c], (1 / fo).ravel()[ys]
            bwc, bwo = np.multiply(wc.T, fc[:, None], order="C"), np.multiply(wo.swapaxes(1, 2), fo[:, :, None], order="C")
            gwc, gbc, gwo, gbo = (np.zeros(w.shape, h.dtype) for w in (wc, bc, wo, bo))
        softmax(0, 0, n, wc, fc, c, less_class, bwc, gwc, gbc)
        for k, (first, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            softmax(1, first, end, wo[k], fo[k], word, less_word, *((None, None, None) if grads is None else (bwo[k], gwo[k], gbo[k])))
        total[0] *= total[1]
        lp[0] += lp[1]
        lp[0] += (bc[:, None] + bo).ravel()[ys]
        lp[0] -= np.log(total[0])
        back = np.empty(n, h.dtype)
        back[order] = lp[0]
        if grads is None:
            return back, None
        for name, g, factor in (("wc", gwc, fc), ("bc", gbc, fc), ("wo", gwo, fo[:, None]), ("bo", gbo, fo)):
            g *= factor
            grads[name] += g
        dh[0] += dh[1]
        unsorted = np.empty_like(hs)
        unsorted[order] = dh[0]
        return back, unsorted

    def tame(self, most: float = 40.0) -> None:
        """Scale down output weights whose logits could leave the range of single-precision exp()."""
        for w, bias, axis in ((self["wc"], self["bc"], 0), (self["wo"], self["bo"], 1)):
            reach = np.abs(w).sum(axis=axis)
            w *= np.expand_dims(np.minimum(1, most / np.maximum(reach, 1e-6)), axis)
            np.clip(bias, -most, most, out=bias)

    def backward(self, x: np.ndarray, keep: np.ndarray, tape: tuple, dout: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Gradients of a window from those of its states. What does not follow the recursion is done for some steps at once, so that it stays near the processor."""
        (steps, lanes), hid, on = x.shape, self.hidden, keep.all(axis=1).tolist()
        before, gates, ns = tape
        through = self.room("through", (steps, lanes, 3, hid), dout.dtype)
        flat, back = through.reshape(steps, lanes, -1), np.ascontiguousarray(self["u"].T)
        dh, more = np.zeros_like(dout[0]), np.empty_like(dout[0])
        for first in range((steps - 1) // PART * PART, -1, -PART):
            some = slice(first, min(first + PART, steps))
            (z, reset, scaled), h, n = gates[some].swapaxes(0, 1), before[some], ns[some]
            dan, dz, rest = 1 - z, h - n, n * n  # slopes by which a state's gradient reaches the candidate, and below both gates and what the reset gate scaled
            dz *= dan
            dz *= z
            np.subtract(1, rest, out=rest)
            dan *= rest
            dn, dr = dan * reset, 2 - 2 * reset  # twice, as the tape holds half
            dr *= dn
            dr *= scaled
            for t in range(some.stop - 1, first - 1, -1):
                dh += dout[t]
                for k, slope in enumerate((dz, dr, dn)):
                    np.multiply(slope[t - first], dh, out=through[t, :, k])
                dan[t - first] *= dh
                dh *= z[t - first]
                np.matmul(flat[t], back, out=more)
                dh += more
                if not on[t]:
                    dh *= keep[t][:, None]
            grads["u"] += (h.swapaxes(1, 2) @ flat[some]).sum(axis=0)  # small products, as in output()
            through[some, :, 2] = dan  # of the embeddings' part of the candidate, which no gate scales
        ids, rows = x.ravel(), flat.reshape(-1, 3 * hid)
        order = np.argsort(ids.astype(np.int16), kind="stable")
        sorted_ids = ids[order]
        heads = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
        by_id, runs = rows.take(order, axis=0, out=self.room("by_id", rows.shape, rows.dtype), mode="clip"), np.diff(np.append(heads, len(ids)))
        falling = np.argsort(-runs, kind="stable")
        heads, runs = heads[falling], runs[falling]
        long, ones = int((runs >= OFTEN).sum()), np.ones(len(ids), dout.dtype)  # long runs add up as products, the others place by place
        sums = np.empty((len(heads), 3 * hid), dout.dtype)
        for k, (a, n) in enumerate(zip(heads[:long].tolist(), runs[:long].tolist(), strict=True)):
            np.matmul(ones[:n], by_id[a : a + n], out=sums[k])
        few, left = heads[long:], runs[long:]
        sums[long:] = by_id.take(few, axis=0)
        for k, n in enumerate(np.searchsorted(-left, -np.arange(1, OFTEN - 1)).tolist(), 1):  # so many runs are longer than k
            sums[long : long + n] += by_id.take(few[:n] + k, axis=0)
        grads["e"][sorted_ids[heads]] += sums


class Lanes:
    """Documents dealt out to lanes, the longest first and each to the shortest lane; lanes by falling length."""

    def __init__(self, docs: list[np.ndarray], lanes: int, piece: int = 0):
        """docs: symbols of each document without the end. With ``piece`` longer ones are cut, and each cut starts anew from the symbol before it: lanes
        are then about equally long, whatever the documents."""
        after, before = [1] * len(docs), [0] * len(docs)  # whether the end follows, and the symbol before
        if piece and any(len(d) > piece for d in docs):
            cuts = [(d, a) for d in docs for a in range(0, max(1, len(d)), piece)]
            after = [int(a + piece >= len(d)) for d, a in cuts]
            before = [int(d[a - 1]) if a else 0 for d, a in cuts]
            docs = [d[a : a + piece] for d, a in cuts]
        lanes = max(1, min(lanes, len(docs)))
        load = [(0, k) for k in range(lanes)]
        dealt: list[list[int]] = [[] for _ in range(lanes)]
        for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
            n, lane = heapq.heappop(load)
            dealt[lane].append(k)
            heapq.heappush(load, (n + len(docs[k]) + after[k], lane))
        length = {lane: n for n, lane in load}
        order = sorted(range(lanes), key=lambda lane: -length[lane])
        self.steps = length[order[0]] if order else 0
        self.lengths = np.array([length[lane] for lane in order])
        # written lane by lane, where a document's symbols lie side by side, and turned once
        x, y, keep = np.zeros((lanes, self.steps), np.int32), np.full((lanes, self.steps), -1, np.int32), np.ones((lanes, self.steps), np.float32)
        self.place = [(0, 0, 0)] * len(docs)
        for at, lane in enumerate(order):
            top = 0
            for k in dealt[lane]:
                d = docs[k]
                end = top + len(d) + after[k]
                x[at, top] = before[k]
                x[at, top + 1 : end] = d[: end - top - 1]
                y[at, top : top + len(d)] = d
                if after[k]:
                    y[at, end - 1] = 0
                keep[at, top] = 0
                self.place[k] = (at, top, end)
                top = end
        self.x, self.y, self.keep = (np.ascontiguousarray(part.T) for part in (x, y, keep))

    def windows(self, size: int):
        """(first step, end, lanes that still run)."""
        for a in range(0, self.steps, size):
            yield a, min(a + size, self.steps), int((self.lengths > a).sum())


def score(model: GRU, docs: list[np.ndarray], lanes: int = 512, window: int = 32) -> np.ndarray:
    """The natural log probability of each whole document, its end included."""
    if not docs:
        return np.zeros(0)
    line = Lanes(docs, lanes)
    lp = np.zeros(line.x.shape, np.float32)
    h = np.zeros((line.x.shape[1], model.hidden), np.float32)
    for a, b, n in line.windows(window):
        out, _ = model.forward(line.x[a:b, :n], h[:n], line.keep[a:b, :n])
        h = out[-1]
        y = line.y[a:b, :n]
        on = y >= 0
        if on.all():
            lp[a:b, :n] = model.output(out.reshape(-1, model.hidden), y.ravel())[0].reshape(y.shape)
        else:
            lp[a:b, :n][on] = model.output(out[on], y[on])[0]
    lp = np.ascontiguousarray(lp.T)
    return np.array([lp[lane, top:end].sum(dtype=np.float64) for lane, top, end in line.place])


def train(model: GRU, docs: list[np.ndarray], memory: np.ndarray, lanes: int = 256, window: int = 32, rate: float = 0.1, piece: int = 768) -> float:
    """One pass of truncated backpropagation with Adagrad (``memory``: its sums of squares). Returns the summed log probability met on the way."""
    if not docs:
        return 0.0
    line, met = Lanes(docs, lanes, piece), 0.0
    share = np.float32(1 / max(1, min(window, line.steps) * line.x.shape[1]) ** 0.5)  # of a full window: the last lanes' tokens weigh no more than others
    flat = np.zeros_like(model.p)
    grads_of = GRU(model.classes, model.hidden, flat=flat)
    grads = {k: grads_of[k] for k in model.at}
    rest = model.at["e"][1]  # only the rows of "e" that a window reads have gradients: the others stay as they are
    own, had, got = model["e"], memory[:rest].reshape(model["e"].shape), grads["e"]
    dense, dense_memory, dense_own = flat[rest:], memory[rest:], model.p[rest:]
    h, room = np.zeros((line.x.shape[1], model.hidden), np.float32), np.empty_like(dense)
    for a, b, n in line.windows(window):
        x, keep, y = line.x[a:b, :n], line.keep[a:b, :n], line.y[a:b, :n]
        out, tape = model.forward(x, h[:n], keep, taped=True)
        h, on = out[-1], y >= 0
        if on.all():
            lp, dout = model.output(out.reshape(-1, model.hidden), y.ravel(), grads)
            dout = dout.reshape(out.shape)
        else:
            dout = np.zeros_like(out)
            lp, dout[on] = model.output(out[on], y[on], grads)
        met += float(lp.sum(dtype=np.float64))
        model.backward(x, keep, tape, dout, grads)
        rows = np.flatnonzero(np.bincount(x.ravel(), minlength=model.size))
        g, m = got[rows], had[rows]
        g *= share
        m += g * g
        had[rows] = m
        np.sqrt(m, out=m)
        g *= np.float32(rate)
        g /= m
        own[rows] -= g
        got[rows] = 0
        dense *= share
        np.multiply(dense, dense, out=room)
        dense_memory += room
        np.sqrt(dense_memory, out=room)
        np.divide(dense, room, out=room)
        room *= np.float32(rate)
        dense_own -= room
        dense[:] = 0
    model.tame()
    return met
