"""Gated recurrent language model that scores complete documents (operator 11).

A text is its words (A-Z lower-cased) and one end mark, each a token.

* Spark counts every token of the training documents. The base score is add-one smoothing over these counts.
* The most frequent tokens get classes of equal size, in the order of their frequency, and all other tokens share a last
  class. The probability of a token is that of its class, given all tokens before it, times its share of the class: a second
  softmax, or in the last class the smoothed count. So every token has a probability, and they sum to one.
* A gated recurrent unit carries the state. It is trained in numpy by backpropagation through windows of ``STEPS`` tokens; the
  state goes on across windows, the gradient does not. Each task trains on its own rows and Spark averages the
  parameters by tokens (``ROUNDS`` times). Every training document passes through, and the gradient is taken in every window
  (``EVERY`` above 1 would take it in one of so many). Lanes without documents left are dropped.
* Scoring runs documents side by side in lanes. A lane goes on with the next document when one ends, so a very long
  document holds one lane and no other; its state is carried from its first token to its last.

The token counts grow with the corpus. The ``gathered`` most frequent tokens travel to the tasks; what the texts hold of all
others is joined with the counts in Spark.

Cases: null and empty texts are the end mark alone; a null key counts as '' and is in the training part; repeated rows are
documents of their own; without training documents every token has probability one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import store

GATHERED = 1 << 18  # tokens whose counts travel to the tasks
CLASSES, MEMBERS = 64, 64  # modelled tokens: 4096
HIDDEN = 16
STEPS, LANES = 32, 128  # window and side-by-side documents in training
EVERY, ROUNDS = 1, 1
RATE = 0.02
END = b""  # the end mark as a token: no word is empty
BLOCK = 4096  # parameters in a row on their way to be averaged
AHEAD = 16  # windows that a lane is filled for at once
HELD, PIECE = 1 << 25, 1 << 22  # bytes of words counted at once, and of texts cut at once
ROWS, NEAR = 1024, 1 << 14  # softmax rows, and parameters, that go through all passes before the next do


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text and the end mark. ``bytes`` lower-cases only A-Z and splits only at ASCII white space."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


# ---- the network -----------------------------------------------------------------------------


class Network:
    """Shapes of the parameters, windows forward and backward. Every class has ``members`` tokens but the last, which is open.

    A layer's bias is the last row of its weights, and a state ends in a one."""

    def __init__(self, n_tokens: int, hidden: int = HIDDEN, members: int = MEMBERS, dtype=np.float32):
        self.n, self.hidden, self.members, self.dtype = n_tokens, hidden, members, dtype
        self.classes = -(-n_tokens // members) + 1
        self.open, self.start = n_tokens, n_tokens + 1  # ids of any other token, and of what stands before the first
        c, h = self.classes, hidden
        self.shapes = {"embed": (n_tokens + 2, h), "input": (h + 1, 3 * h), "state": (h + 1, 3 * h), "class": (h + 1, c), "member": (c - 1, h + 1, members)}
        self.size = sum(math.prod(s) for s in self.shapes.values())

    def initial(self, counts: np.ndarray, other: float) -> np.ndarray:
        """Small random weights; biases that reproduce the counts, so that training starts at the token frequencies."""
        rng = np.random.default_rng(11)
        flat = np.zeros(self.size)
        p = self.parts(flat)
        for k, scale in (("embed", 0.5), ("wx", self.hidden**-0.5), ("u", self.hidden**-0.5), ("wc", 0.1)):
            p[k][:] = rng.normal(0, scale, p[k].shape)
        padded = np.full((self.classes - 1) * self.members, 1e-9)
        padded[: self.n] = counts
        padded = padded.reshape(-1, self.members)
        mass = np.append(padded.sum(1), max(other, 0.5))
        p["bc"][:] = np.log(mass / mass.sum())
        p["bw"][:] = np.log(padded / padded.sum(1, keepdims=True))
        return flat.astype(self.dtype)

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of the flat parameters by name: whole layers, and their weights and biases."""
        out, at = {}, 0
        for k, shape in self.shapes.items():
            n = math.prod(shape)
            out[k] = flat[at : at + n].reshape(shape)
            at += n
        for layer, w, b in (("input", "wx", "bx"), ("state", "u", "bu"), ("class", "wc", "bc")):
            out |= {w: out[layer][:-1], b: out[layer][-1]}
        return out | {"ww": out["member"][:, :-1].transpose(0, 2, 1), "bw": out["member"][:, -1]}

    def table(self, p: dict[str, np.ndarray], embed: np.ndarray) -> np.ndarray:
        """What inputs with these embeddings add to the gates; for the two that are logistic, the negative of that."""
        w = p["input"].copy()
        w[:, : 2 * self.hidden] *= -1
        out = embed @ w[:-1]
        out += w[-1]
        return out

    def states(self, p: dict[str, np.ndarray], table: np.ndarray, at: np.ndarray, alive: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States (steps, hidden + 1, lanes) from state h (lanes, hidden) over inputs, which are rows ``at`` (steps, lanes) of the
        table; where not ``alive``, a document starts. ``keep`` collects what the way back needs. The lanes come last, so that
        each gate of a step is one run of memory."""
        n = self.hidden
        steps, lanes = at.shape
        some, alive = (~alive).any(1).tolist(), alive.astype(self.dtype)
        given = np.ascontiguousarray(np.take(table, at, 0, mode="clip").transpose(0, 2, 1))
        u = np.ascontiguousarray(p["state"].T)
        u[: 2 * n] *= -1
        out = np.empty((steps + 1, n + 1, lanes), self.dtype)
        out[:, n] = 1
        out[0, :n] = h.T
        held = 1 if keep is None else steps
        gates, cs = (np.empty((held, k * n, lanes), self.dtype) for k in (3, 1))
        views = [(g, g[: 2 * n], g[:n], g[n : 2 * n], g[2 * n :], c) for g, c in zip(gates, cs)]
        h = out[0]
        for t in range(steps):
            if some[t]:
                h = h.copy()
                h[:n] *= alive[t]
            gate, zr, z, r, own, c = views[t % held]
            np.matmul(u, h, out=gate)
            x = given[t]
            zr += x[: 2 * n]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(r, own, out=c)
            c += x[2 * n :]
            np.tanh(c, out=c)
            after = out[t + 1]
            d = np.subtract(h[:n], c, out=after[:n])
            d *= z
            d += c
            h = after
        if keep is not None:
            before = out[:-1].copy()
            before[:, :n] *= alive[:, None, :]
            keep |= {"before": before, "z": gates[:, :n], "r": gates[:, n : 2 * n], "own": gates[:, 2 * n :], "c": cs, "alive": alive, "some": some}
        return out[1:]

    def _shares(self, logits: np.ndarray, most: float, target: np.ndarray, scale: float | None) -> np.ndarray:
        """Targets' log-probabilities; with ``scale``, the logits give way to their gradients, times scale."""
        if most > 60:  # the logits are within +-most; below that nothing overflows
            logits -= logits.max(1, keepdims=True)
        at = np.arange(0, logits.size, logits.shape[1]) + target
        flat = logits.ravel()
        own = flat[at]
        e = np.exp(logits, out=logits)
        total = e @ np.ones(e.shape[1], self.dtype)
        if scale is not None:
            e *= (scale / total)[:, None]
            flat[at] -= scale
        return np.minimum(own - np.log(total), 0)

    def log_probability(self, p, states: np.ndarray, y: np.ndarray, back: dict | None = None, scale: float = 1.0) -> np.ndarray:
        """Natural log of each target's class and share (0 where y < 0). States (rows ending in a one) and y are flat. The open
        class has no share here. With ``back``, adds the gradients of the negative sum, times ``scale``, to its arrays and
        leaves the states' gradient in it."""
        valid = y >= 0
        cls = np.where(valid, y // self.members, 0)
        cls[y == self.open] = self.classes - 1
        out = np.empty(len(y), np.float64)
        w = p["class"]
        most = float(np.abs(w).sum(0).max())  # states are within -1 and 1
        if back is not None:
            scale = self.dtype(scale)
            back["states"] = np.empty_like(states)
        logits = np.empty((min(len(y), ROWS), self.classes), self.dtype)
        for i in range(0, len(y), ROWS):  # few rows at once stay near the processor
            s = states[i : i + ROWS]
            d = np.matmul(s, w, out=logits[: len(s)])
            out[i : i + ROWS] = self._shares(d, most, cls[i : i + ROWS], None if back is None else scale)
            if back is not None:
                d[~valid[i : i + ROWS]] = 0
                back["class"] += (d.T @ s).T
                np.matmul(d, w.T, out=back["states"][i : i + ROWS])
        out[~valid] = 0
        inner = np.flatnonzero(valid & (cls < self.classes - 1))
        if not len(inner):
            return out
        inner = inner[np.argsort(cls[inner].astype(np.int16), kind="stable")]
        bounds = np.searchsorted(cls[inner], np.arange(self.classes)).tolist()
        runs = [(c, i, j) for c, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
        states, w = states[inner], p["member"]
        # one product a class; all else goes over the tokens of all classes at once
        d = np.empty((len(inner), self.members), self.dtype)
        runs = [(c, states[i:j], d[i:j], i, j) for c, i, j in runs]
        for c, s, e, *_ in runs:
            np.matmul(s, w[c], out=e)
        out[inner] += self._shares(d, float(np.abs(w).sum(1).max()), y[inner] % self.members, None if back is None else scale)
        if back is not None:
            more, turned, to = np.empty_like(states), w.transpose(0, 2, 1), back["member"]
            for c, s, e, i, j in runs:
                np.matmul(e, turned[c], out=more[i:j])
                np.matmul(s.T, e, out=to[c])
            back["states"][inner] += more
        return out

    def _sums(self, rows: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums of rows[order] from each start to the next."""
        sizes = np.diff(starts, append=len(order))
        few = sizes <= 32
        out = np.empty((len(starts), rows.shape[1]), self.dtype)
        for k in np.flatnonzero(~few).tolist():  # of many rows a product is faster
            i, m = int(starts[k]), int(sizes[k])
            np.matmul(np.ones(m, self.dtype), rows.take(order[i : i + m], 0), out=out[k])
        if few.any():
            ends = np.cumsum(sizes[few])
            out[few] = np.add.reduceat(rows.take(order[np.repeat(few, sizes)], 0), ends - sizes[few], 0)
        return out

    def gradient(self, p, x: np.ndarray, y: np.ndarray, h: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
        """(gradient of the mean negative log-probability, its sum, last states) of one window. ``space`` may hold the gradient."""
        kept: dict = {}
        n, (steps, lanes) = self.hidden, x.shape
        # equal inputs lie together: the gates' share of each is computed once, and so is its gradient
        inputs = x.ravel()
        order = np.argsort(inputs.astype(np.int16) if self.start < 1 << 15 else inputs, kind="stable")
        lying = inputs[order]
        first = np.empty(len(lying), bool)
        first[0] = True
        np.not_equal(lying[1:], lying[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        which = np.empty(len(lying), np.int64)
        which[order] = np.cumsum(first) - 1
        unique = lying[starts]
        embed = p["embed"].take(unique, 0)
        out = self.states(p, self.table(p, embed), which.reshape(x.shape), x != self.start, h, kept)
        flat = np.empty(self.size, self.dtype) if space is None else space
        flat.fill(0)
        back = self.parts(flat)
        rows = np.ascontiguousarray(out.transpose(0, 2, 1)).reshape(-1, n + 1)
        loss = -self.log_probability(p, rows, y.ravel(), back, 1 / max(int((y >= 0).sum()), 1)).sum()
        d_out = np.ascontiguousarray(back.pop("states").reshape(steps, lanes, n + 1).transpose(0, 2, 1)[:, :n])
        before, z, r, own, c, alive, some = kept.values()
        # each gate's gradient is the state's times what does not depend on it: only that product is left to the steps.
        # In this order the first three gates go back to the state and the last three to the input.
        by = np.empty((steps, 4, n, lanes), self.dtype)
        own_by, z_by, r_by, c_by = (by[:, k] for k in range(4))
        rest = 1 - z
        np.multiply(c, c, out=c_by)
        np.subtract(1, c_by, out=c_by)
        c_by *= rest
        np.subtract(before[:, :n], c, out=z_by)
        z_by *= rest
        z_by *= z
        np.multiply(c_by, r, out=own_by)
        np.subtract(1, r, out=r_by)
        r_by *= own
        r_by *= own_by
        u = np.concatenate([p["u"][:, 2 * n :], p["u"][:, : 2 * n]], 1)
        to_state, to_input = by[:, :3].reshape(steps, 3 * n, lanes), by[:, 1:].reshape(steps, 3 * n, lanes)
        dh, through = np.zeros((n, lanes), self.dtype), np.empty((n, lanes), self.dtype)
        for t in range(steps - 1, -1, -1):
            dh += d_out[t]
            by[t] *= dh  # a step's factors give way to its gradients
            dh *= z[t]
            dh += np.matmul(u, to_state[t], out=through)
            if some[t]:
                dh *= alive[t]
        d = np.matmul(to_state, before.transpose(0, 2, 1)).sum(0).T
        back["state"][:, 2 * n :] = d[:, :n]
        back["state"][:, : 2 * n] = d[:, n:]
        rows = np.ascontiguousarray(to_input.transpose(0, 2, 1)).reshape(-1, 3 * n)
        d = self._sums(rows, order, starts)
        back["wx"][:] = embed.T @ d
        back["bx"][:] = d.sum(0)
        back["embed"][unique] = d @ p["wx"].T
        return flat, float(loss), out[-1, :n].T


# ---- lanes -----------------------------------------------------------------------------------


class Lanes:
    """Documents side by side. ``docs`` yields (handle, ids); each window continues every lane's document, or the next."""

    def __init__(self, docs: Iterator[tuple], lanes: int, start: int):
        self.docs, self.start, self.more = docs, start, True
        self.now: list = [None] * lanes

    def window(self, steps: int) -> tuple[np.ndarray, np.ndarray, list]:
        """(inputs, targets, pieces): arrays (steps, lanes), targets -1 in idle places; a piece is (handle, lane, from,
        to, whether the document ends there). Without documents left, no pieces."""
        x = np.full((len(self.now), steps), self.start, np.int64)
        y = np.full((len(self.now), steps), -1, np.int64)
        pieces = []
        for lane, now in enumerate(self.now):
            t = 0
            while t < steps:
                if now is None:
                    now = next(self.docs, None)
                    if now is None:
                        self.more = False
                        break
                    now = (*now, 0)
                handle, ids, at = now
                m = min(steps - t, len(ids) - at)
                y[lane, t : t + m] = ids[at : at + m]
                if at:
                    x[lane, t : t + m] = ids[at - 1 : at + m - 1]
                else:
                    x[lane, t + 1 : t + m] = ids[: m - 1]
                ended = at + m == len(ids)
                pieces.append((handle, lane, t, t + m, ended))
                now = None if ended else (handle, ids, at + m)
                t += m
            self.now[lane] = now
        return x.T, y.T, pieces

    def cut(self, x: np.ndarray, y: np.ndarray, steps: int) -> Iterator[tuple]:
        """(from, lanes, inputs, targets) of the short windows in a long one, without the lanes that stay idle from there on."""
        filled = None if self.more else (y >= 0).sum(0)  # idle places are a lane's last
        for t in range(0, len(x), steps):
            used = slice(None) if filled is None else np.flatnonzero(filled > t)
            if filled is not None and not len(used):
                return
            yield t, used, x[t : t + steps, used], y[t : t + steps, used]

    def narrowed(self, h: np.ndarray) -> np.ndarray:
        """Lane states ``h`` without the lanes that stay idle: once no documents are left, those that hold none are dropped."""
        if self.more:
            return h
        used = [i for i, now in enumerate(self.now) if now is not None]
        self.now = [self.now[i] for i in used]
        return h[used]


def _keep_memory() -> None:
    """The C library gives arrays of some hundred KB back to the system and fetches them again, page by page, for the next window.
    It keeps such sizes once a block as large as this was freed."""
    np.empty(1 << 24, np.uint8)


class Adam:
    """Adam with a falling rate, the gradient's norm at most 1, on ``flat`` in place. ``mean`` averages the parameters over the
    steps, later ones weighing more, so that the last rows' texts do not decide."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.steps = flat, rate, 0
        self.m, self.v, self.away = (np.zeros_like(flat) for _ in range(3))  # sums of gradients and squares, flat - mean
        self.space = np.empty(min(len(flat), NEAR), flat.dtype)

    def step(self, g: np.ndarray) -> None:
        self.steps += 1
        norm = max(math.sqrt(g @ g), 1.0)
        # with sums instead of means, m is 10 and v 1000 times what Adam has; both are for gradients of any norm
        root = (0.001 / (1 - 0.999**self.steps)) ** 0.5
        now = self.rate / math.sqrt(1 + self.steps / 50) * 0.1 / (1 - 0.9**self.steps) / root
        kept = 1 - 3 / (self.steps + 2)
        for i in range(0, len(g), NEAR):  # all passes over some parameters, then the next
            d, m, v, flat, away = (a[i : i + NEAR] for a in (g, self.m, self.v, self.flat, self.away))
            space = self.space[: len(d)]
            if norm > 1:
                d /= norm
            m *= 0.9
            m += d
            d *= d
            v *= 0.999
            v += d
            np.sqrt(v, out=space)
            space += 1e-6 / root
            np.divide(m, space, out=space)
            space *= now
            flat -= space
            away -= space
            away *= kept

    @property
    def mean(self) -> np.ndarray:
        return self.flat - self.away


def fit(net: Network, flat: np.ndarray, docs: Iterator[np.ndarray], every: int = EVERY, rate: float = RATE) -> tuple[np.ndarray, int]:
    """(parameters, tokens in trained windows) after one pass over ``docs``."""
    _keep_memory()
    side = Lanes(((None, ids) for ids in docs), LANES, net.start)
    adam, space = Adam(flat.copy(), rate), np.empty_like(flat)
    p = net.parts(adam.flat)
    h = np.zeros((LANES, net.hidden), net.dtype)
    seen = number = 0
    while True:
        xs, ys, pieces = side.window(STEPS * AHEAD)
        if not pieces:
            return adam.mean, seen
        for _, used, x, y in side.cut(xs, ys, STEPS):
            if number % every == 0:
                g, _, h[used] = net.gradient(p, x, y, h[used], space)
                adam.step(g)
                seen += int((y >= 0).sum())
            else:
                h[used] = net.states(p, net.table(p, p["embed"]), x, x != net.start, h[used])[-1, : net.hidden].T
            number += 1
        h = side.narrowed(h)


def log_probabilities(net: Network, flat: np.ndarray, docs: Iterator[tuple], lanes: int = 256, steps: int = 64) -> Iterator[tuple]:
    """(handle, natural log-probability without the open class's shares) of each document, as they end."""
    _keep_memory()
    p = net.parts(flat)
    table, side = net.table(p, p["embed"]), Lanes(docs, lanes, net.start)
    h = np.zeros((lanes, net.hidden), net.dtype)
    sums: dict = {}
    while True:
        xs, ys, pieces = side.window(steps * AHEAD)
        if not pieces:
            return
        upto = np.zeros((len(ys) + 1, ys.shape[1]))
        for t, used, x, y in side.cut(xs, ys, steps):
            states = net.states(p, table, x, x != net.start, h[used])
            rows = np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, net.hidden + 1)
            upto[t + 1 : t + 1 + len(y), used] = net.log_probability(p, rows, y.ravel()).reshape(y.shape)
            h[used] = states[-1, : net.hidden].T
        np.cumsum(upto, 0, out=upto)
        lane, a, b = (np.array([q[i] for q in pieces]) for i in (1, 2, 3))
        for (handle, *_, ended), s in zip(pieces, (upto[b, lane] - upto[a, lane]).tolist()):
            s += sums.pop(handle, 0.0)
            if ended:
                yield handle, s
            else:
                sums[handle] = s
        h = side.narrowed(h)


# ---- counts ----------------------------------------------------------------------------------


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, none empty, as binary; how many each text has), the same as of ``tokens`` without the end marks."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    words, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
    real = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[np.concatenate([[0], ends])]
    return words.filter(real).cast(pa.binary()), np.diff(upto)


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in their order, of no more than ``PIECE`` bytes of text at once and one text beyond, however long the texts are."""
    for batch in batches:
        piece = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64) // PIECE
        starts = np.flatnonzero(np.diff(piece, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(batch)]):
            yield batch.slice(a, b - a)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of a partition, emitted whenever the words of many bytes are held."""
    held: list[pa.Array] = []
    size = texts = 0

    def emit():
        found = pa.chunked_array(held, pa.binary()).value_counts()
        token, n = (pa.concat_arrays([found.field(i), pa.array([last], found.field(i).type)]) for i, last in enumerate((END, texts)))
        return pa.record_batch({"token": token, "n": n})

    for batch in _pieces(batches, 0):
        words, _ = _words(batch.column(0))
        held.append(words)
        size += words.nbytes
        texts += len(batch)
        if size > HELD:
            yield emit()
            held, size, texts = [], 0, 0
    if texts:
        yield emit()


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """token (binary), n (long) over all texts of ``docs``."""
    part = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, "token binary, n long")
    return part.groupBy("token").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[int, list[tuple[bytes, int]]]:
    """(least count, [(token, n)]) of at most ``most`` tokens, those of the least count and above, by falling count."""
    grade = F.floor(8 * F.log2("n")).cast("int")
    sizes = {r["grade"]: r["size"] for r in counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("size")).collect()}
    least, held = -1, 0
    for g in sorted(sizes, reverse=True):
        held += sizes[g]
        if held > most:
            least = g
            break
    head = counts.filter(grade > least).select("token", "n").toArrow()
    rows = sorted(zip(head["token"].to_pylist(), head["n"].to_pylist()), key=lambda r: (-r[1], r[0]))
    return least, rows


# ---- documents -------------------------------------------------------------------------------

_ENCODED = {
    "ids": pa.binary(), "n_tokens": pa.int64(), "n_known": pa.int64(), "logs": pa.float64(), "open_logs": pa.float64(),
    "n_open": pa.int64(), "rare": pa.list_(pa.binary()), "times": pa.list_(pa.int64()),
}


def _stored(modelled: int) -> np.dtype:
    """How ids lie in a document's bytes. As bytes they pass through Spark whole, as an array number by number."""
    return np.dtype("<i2" if modelled < 1 << 15 else "<i4")


def encode(docs: DataFrame, key: str, text: str, held_out: Column, head: list[tuple[bytes, int]], modelled: int) -> DataFrame:
    """One row a document: key, held_out, the ids of its tokens (``modelled``: any other) as bytes, sums of log10(count + 1) over all tokens
    and over those that are not modelled, and the tokens outside ``head`` with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = {token: i for i, (token, _) in enumerate(sent.value)}.get
        logs = np.log10(np.array([n + 1 for _, n in sent.value] + [1], np.float64))
        for batch in _pieces(batches, 2):
            words, lengths = _words(batch.column(2))
            # each different word is looked up once; after the words of a document comes the end mark
            coded = words.dictionary_encode()
            different = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
            ends = np.cumsum(lengths + 1)
            code = np.full(ends[-1], len(different) - 1, np.int64)
            is_word = np.ones(len(code), bool)
            is_word[ends - 1] = False
            code[is_word] = coded.indices.to_numpy()
            at = np.fromiter(map(find, different.to_pylist(), repeat(-1)), np.int64, len(different))[code]
            known, open_, log = at >= 0, (at < 0) | (at >= modelled), logs[at]  # the last log, 0, for unknown tokens
            starts = ends - lengths - 1
            ids = np.where(open_, modelled, at).astype(_stored(modelled))
            places = (np.append(0, ends) * ids.itemsize).astype(np.int32)
            # (document, token) pairs outside the head, with their numbers
            of = np.repeat(np.arange(len(ends)), lengths + 1)[~known]
            pairs, times = np.unique(of * len(different) + code[~known], return_counts=True)
            upto = pa.array(np.searchsorted(pairs, np.arange(len(ends) + 1) * len(different)), pa.int32())
            found = {
                "ids": pa.Array.from_buffers(pa.binary(), len(ends), [None, *map(pa.py_buffer, (places, ids))]),
                "n_tokens": lengths + 1,
                "n_known": np.add.reduceat(known, starts, dtype=np.int64),
                "logs": np.add.reduceat(log, starts),
                "open_logs": np.add.reduceat(np.where(open_, log, 0), starts),
                "n_open": np.add.reduceat(open_, starts, dtype=np.int64),
                "rare": pa.ListArray.from_arrays(upto, different.take(pa.array(pairs % len(different)))),
                "times": pa.ListArray.from_arrays(upto, pa.array(times, pa.int64())),
            }
            arrays = [pa.array(found[c], kind) for c, kind in _ENCODED.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=["key", "held_out", *_ENCODED])

    narrow = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    found = narrow.mapInArrow(
        run,
        f"key {kind}, held_out boolean, ids binary, n_tokens long, n_known long, logs double, open_logs double, n_open long, "
        "rare array<binary>, times array<long>",
    )
    return store(found.withColumn("row", F.monotonically_increasing_id()), "encoded")


def _documents(column: pa.Array, modelled: int) -> Iterator[np.ndarray]:
    """The ids of each document."""
    for ids in column:
        yield np.frombuffer(ids.as_buffer(), _stored(modelled))


def train(encoded: DataFrame, net: Network, flat: np.ndarray, rounds: int = ROUNDS, every: int = EVERY) -> np.ndarray:
    """Parameters after ``rounds`` of training in every task and averaging over all tasks."""
    ids = encoded.filter("NOT held_out").select("ids")
    context = encoded.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            mine, seen = fit(net, sent.value, (ids for batch in batches for ids in _documents(batch.column(0), net.n)), every)
            if seen:
                blocks = [mine[i : i + BLOCK].astype(np.float64) * seen for i in range(0, len(mine), BLOCK)]
                yield pa.record_batch(
                    {"block": pa.array(range(len(blocks)), pa.int32()), "v": pa.array(blocks, pa.list_(pa.float64())), "seen": pa.array([seen] * len(blocks), pa.int64())}
                )

        # one row a parameter and task, summed by parameter: no task receives all
        trained = ids.mapInArrow(run, "block int, v array<double>, seen long")
        each = trained.select("block", F.posexplode("v").alias("pos", "v"), "seen")
        mean = each.groupBy("block", "pos").agg((F.sum("v") / F.sum("seen")).alias("v")).toArrow()
        if mean.num_rows:
            at = mean["block"].to_numpy().astype(np.int64) * BLOCK + mean["pos"].to_numpy()
            flat = flat.copy()
            flat[at] = mean["v"].to_numpy()
    return flat


def score(encoded: DataFrame, net: Network, flat: np.ndarray) -> DataFrame:
    """row, network: the natural log-probability of each document of ``encoded`` but for its open tokens' shares."""
    sent = encoded.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), _documents(batch.column(1), net.n))

        scored = log_probabilities(net, sent.value, numbered())
        while some := list(islice(scored, 10_000)):
            rows, logs = zip(*some)
            yield pa.record_batch({"row": pa.array(rows, pa.int64()), "network": pa.array(logs, pa.float64())})

    return encoded.select("row", "ids").mapInArrow(run, "row long, network double")


def report(
    docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", gathered: int = GATHERED, classes: int = CLASSES,
    members: int = MEMBERS, hidden: int = HIDDEN, rounds: int = ROUNDS, every: int = EVERY,
) -> DataFrame:
    """One row a document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    marked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), held_out.alias("held"))
    counts = store(token_counts(marked.filter("NOT held"), "text"), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, head = most_frequent(counts, gathered)
    frequent = np.array([c for _, c in head[: classes * members]], np.float64)
    net = Network(len(frequent), hidden, members)
    other = float(n - frequent.sum())
    encoded = encode(marked, "key", "text", F.col("held"), head, net.n)
    flat = train(encoded, net, net.initial(frequent, other), rounds, every)
    scored = store(score(encoded, net, flat), "recurrent")
    # tokens outside the head: their counts are joined, and those without any add nothing
    each = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("g")).select("row", F.col("g.rare").alias("token"), "g.times")
    tail = counts.filter(F.floor(8 * F.log2("n")).cast("int") <= least)
    rest = each.join(tail, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    all_ = encoded.drop("ids", "rare", "times").join(scored, "row").join(rest, "row", "left")
    more, logs = F.coalesce("more", F.lit(0).cast("long")), F.coalesce("more_logs", F.lit(0.0))
    base = math.log10(n + v + 1)
    open_ = math.log10(other + (v - net.n) + 1)  # all tokens of the last class, and one for any unknown
    return all_.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("network") / math.log(10) + F.col("open_logs") + logs - F.col("n_open") * open_).alias("score"),
    )
