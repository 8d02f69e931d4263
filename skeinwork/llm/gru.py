"""A gated recurrent language model with a class-factored softmax, in numpy.

Tokens are codes: the most frequent words have one each, other words share the code of their form. The output has two levels: a class
(each of the few most frequent words is one, every form is one), and, within a form's class, its coded words and a rest. Both levels are
softmaxes of the recurrent state. Training is truncated backpropagation over windows; states are carried from window to window, in
training and in scoring, and start anew with each document.

The recurrence holds units in rows and lanes in columns, so that the parts of a gate are whole blocks of memory. The output takes the states
class by class, a state together in memory, so that they are gathered and dealt back once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Units of the state and of the embedding; words with a code, those that are classes of their own, and forms.
STATE, EMBED, WORDS, SINGLES, FORMS = 24, 16, 2048, 48, 48
CODES, CLASSES = WORDS + FORMS, SINGLES + FORMS
#: Steps of a window in training and in scoring, rows that move together in scoring, and columns of the class softmax that are taken together.
STEPS, WINDOW, LANES, COLUMNS = 32, 64, 512, 2048
#: In training a document is read in parts of so many tokens, each from a fresh state, so that a very long one doesn't leave lanes idle.
PART = 2048
Params = dict[str, np.ndarray]


@dataclass
class Output:
    """How codes fall into classes: class of each code, its place in the class, and each form class's codes (the rest last)."""

    cls: np.ndarray
    place: np.ndarray
    members: list[np.ndarray]

    @classmethod
    def of(cls, forms: np.ndarray) -> Output:
        """``forms``: the form of each coded word, most frequent word first."""
        full = np.concatenate([forms, np.full(WORDS - len(forms), -1), np.arange(FORMS)]).astype(np.int64)
        klass = SINGLES + full
        klass[:SINGLES] = np.arange(SINGLES)
        place, members = np.zeros(CODES, np.int64), []
        for f in range(FORMS):
            codes = SINGLES + np.flatnonzero(full[SINGLES:] == f)
            place[codes] = np.arange(len(codes))
            members.append(codes)
        return cls(klass, place, members)


SHAPES = {"E": (CODES, EMBED), "W": (EMBED, 3 * STATE), "b": (3 * STATE,), "R": (STATE, 3 * STATE), "C": (STATE, CLASSES), "c": (CLASSES,), "U": (CODES, STATE), "u": (CODES,)}


def views(flat: np.ndarray) -> Params:
    """The parameters by name, as views of one array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def packed(p: Params) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in SHAPES])


def start(output: Output, counts: np.ndarray, seed: int = 11) -> Params:
    """Parameters whose first predictions are the counts' shares. ``counts``: of each code."""
    random = np.random.default_rng(seed)
    known = output.cls >= 0
    by_class = np.bincount(output.cls[known], weights=counts[known], minlength=CLASSES) + 0.5
    p = {name: random.normal(0, 0.1, shape).astype(np.float32) for name, shape in SHAPES.items()}
    return p | {"b": np.zeros(3 * STATE, np.float32), "c": np.log(by_class / by_class.sum()).astype(np.float32), "u": np.log(counts + 0.5).astype(np.float32)}


def lanes_of(docs: list[np.ndarray], most: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest lane first; fewer lanes where one document is long."""
    sizes = np.array([len(d) for d in docs])
    n = int(np.clip(-(-sizes.sum() // max(int(sizes.max()), 256)), 1, most))
    lanes: list[list[int]] = [[] for _ in range(n)]
    load = np.zeros(n, np.int64)
    for k in np.argsort(-sizes, kind="stable"):
        i = int(np.argmin(load))
        lanes[i].append(int(k))
        load[i] += sizes[k]
    return [lanes[i] for i in np.argsort(-load, kind="stable")]


def stream(docs: list[np.ndarray], lanes: list[list[int]], before: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (step, lane): the code read, the code to predict, and the document (-1 after a lane's end). ``before``: read before each document."""
    steps = max(sum(len(docs[k]) for k in lane) for lane in lanes)
    read, target = np.zeros((steps, len(lanes)), np.int32), np.zeros((steps, len(lanes)), np.int32)
    doc = np.full((steps, len(lanes)), -1, np.int32)
    for i, lane in enumerate(lanes):
        at = 0
        for k in lane:
            n = len(docs[k])
            read[at, i], read[at + 1 : at + n, i], target[at : at + n, i], doc[at : at + n, i] = before[k], docs[k][:-1], docs[k], k
            at += n
    return read, target, doc


def starts(doc: np.ndarray) -> np.ndarray:
    """Where a document begins in its lane."""
    new = np.ones_like(doc, bool)
    new[1:] = doc[1:] != doc[:-1]
    return new


@np.errstate(over="ignore")  # a gate that is 0 then
def recurrence(p: Params, read: np.ndarray, new: np.ndarray, h: np.ndarray, kept: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By step (unit, lane): what goes in (the state before it, the embedding, one), the gates and twice the recurrent part of the candidate, candidates and
    states after it. All but the states have the last step alone unless ``kept``. A step's arrays are made together, so that they are in the cache."""
    steps, lanes = read.shape
    # rows: the gates', with the other sign (a gate is 1 / (1 + exp of that)), then twice the candidate's, from the state and from the rest apart (its tanh
    # is 1 - 2 / (1 + exp of that))
    weights = np.zeros((4 * STATE, STATE + EMBED + 1), h.dtype)
    every = np.concatenate([p["R"], p["W"], p["b"][None]]).T
    weights[: 2 * STATE] = -every[: 2 * STATE]
    weights[2 * STATE : 3 * STATE, :STATE] = 2 * every[2 * STATE :, :STATE]
    weights[3 * STATE :, STATE:] = 2 * every[2 * STATE :, STATE:]
    embedded = np.ascontiguousarray(p["E"].T.astype(h.dtype))
    x, product, candidate = (np.empty((steps if kept else 1, n, lanes), h.dtype) for n in (STATE + EMBED + 1, 3 * STATE, STATE))
    after, u = np.empty((steps, STATE, lanes), h.dtype), np.empty((4 * STATE, lanes), h.dtype)
    x[:, -1] = 1
    some = new.any(axis=1)
    for k in range(steps):
        j = k if kept else 0
        before, v, n = x[j, :STATE], x[j], candidate[j]
        before[:] = h
        if some[k]:
            before *= ~new[k]
        np.take(embedded, read[k], axis=1, out=v[STATE:-1], mode="clip")  # codes are within it; another mode would copy
        g, un, h = product[j, : 2 * STATE], product[j, 2 * STATE :], after[k]
        np.matmul(weights, v, out=u)
        np.exp(u[: 2 * STATE], out=g)
        g += 1
        np.reciprocal(g, out=g)
        np.multiply(g[STATE:], u[2 * STATE : 3 * STATE], out=un)
        np.add(un, u[3 * STATE :], out=n)
        np.exp(n, out=n)
        n += 1
        np.reciprocal(n, out=n)
        n *= -2
        n += 1
        np.subtract(before, n, out=h)
        h *= g[:STATE]
        h += n
    return x, product, candidate, after


def columns(x: np.ndarray) -> np.ndarray:
    """(step, unit, lane) as (unit, step and lane), with a last row of ones; in memory a column's numbers stand together."""
    steps, units, lanes = x.shape
    out = np.ones((steps, lanes, units + 1), x.dtype)
    out[:, :, :units] = x.transpose(0, 2, 1)
    return out.reshape(-1, units + 1).T


@np.errstate(over="ignore", divide="ignore", invalid="ignore")  # such columns are computed anew
def settled(weights: np.ndarray, states: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Softmaxes of ``weights`` times the columns: log probabilities of the rows ``at``, one per column; the exponentials and their sums by column."""
    e = weights @ states
    found = e.ravel().take(at * len(at) + np.arange(len(at)))
    np.exp(e, out=e)
    total = e.sum(axis=0)
    logs = found - np.log(total)
    if not np.isfinite(logs).all():  # exponentials beyond the numbers' range: less the largest, they are not
        bad = np.flatnonzero(~np.isfinite(logs))
        logits = weights @ states[:, bad]
        logits -= logits.max(axis=0)
        found = logits[at[bad], np.arange(len(bad))]
        e[:, bad] = np.exp(logits)
        total[bad] = e[:, bad].sum(axis=0)
        logs[bad] = found - np.log(total[bad])
    return logs, e, total


def descent(weights: np.ndarray, states: np.ndarray, at: np.ndarray, outward: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss of softmaxes over the columns, its gradients by ``weights``, and, a row per column, by the states (units only)."""
    logs, e, total = settled(weights, states, at)
    e.ravel()[at * len(at) + np.arange(len(at))] -= total  # the gradients by the logits, times the sums
    return -float(logs.sum()), e @ (states / total).T, (e.T @ outward) / total[:, None]


class Heads:
    """The output's two levels as matrices with their biases as a last column; a form's codes stand together."""

    def __init__(self, p: Params, output: Output) -> None:
        self.order = np.concatenate(output.members)
        self.bounds = np.cumsum([0, *map(len, output.members)])
        self.classes = np.concatenate([p["C"].T, p["c"][:, None]], axis=1)
        self.codes = np.concatenate([p["U"], p["u"][:, None]], axis=1)[self.order]


def by_class(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns class by class, and where each form's begin (FORMS + 1)."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    return order, np.searchsorted(cls[order], np.arange(SINGLES, CLASSES + 1))


def log_probabilities(p: Params, output: Output, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the target codes' probabilities, given the states before them (as ``columns`` gives them)."""
    heads, order, bounds = Heads(p, output), *by_class(output.cls[target])
    states, target = states.T[order].T, target[order]
    cls, place, found, out = output.cls[target], output.place[target], np.empty(len(target), states.dtype), np.empty(len(target), states.dtype)
    for i in range(0, len(target), COLUMNS):
        part = slice(i, i + COLUMNS)
        found[part] = settled(heads.classes, states[:, part], cls[part])[0]
    for f in range(FORMS):
        if bounds[f + 1] > bounds[f]:
            part, own = slice(bounds[f], bounds[f + 1]), slice(heads.bounds[f], heads.bounds[f + 1])
            found[part] += settled(heads.codes[own], states[:, part], place[part])[0]
    out[order] = found
    return out


def score(p: Params, output: Output, docs: list[np.ndarray], first: int, window: int = WINDOW) -> np.ndarray:
    """Natural log probability of every document (arrays of codes, each ending with the end code), read whole from its own first state."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    lanes = lanes_of(docs, LANES)
    length = np.array([sum(len(docs[k]) for k in lane) for lane in lanes])
    read, target, doc = stream(docs, lanes, [first] * len(docs))
    new = starts(doc)
    h = np.zeros((STATE, len(lanes)), np.float32)
    for at in range(0, len(read), window):
        live = int((length > at).sum())  # lanes are ordered by length
        part = slice(at, at + window), slice(0, live)
        *_, states = recurrence(p, read[part], new[part], h[:, :live], kept=False)
        h, goal, d = states[-1], target[part].ravel(), doc[part].ravel()
        used = np.flatnonzero(d >= 0) if (d < 0).any() else slice(None)
        total += np.bincount(d[used], weights=log_probabilities(p, output, columns(states)[:, used], goal[used]), minlength=len(docs))
    return total


def window_gradients(p: Params, output: Output, read: np.ndarray, target: np.ndarray, doc: np.ndarray, new: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray, float]:
    """Gradients of the mean loss over a window, the state after it, and the loss."""
    x, product, n, after = recurrence(p, read, new, h)
    used = np.flatnonzero(doc.ravel() >= 0)
    order, bounds = by_class(output.cls[target.ravel()[used]])
    used = used[order]
    flat, goal = columns(after).T[used].T, target.ravel()[used]
    heads, cls, place, m, loss = Heads(p, output), output.cls[goal], output.place[goal], len(used), 0.0
    d_classes, d_codes, d_flat = np.zeros_like(heads.classes), np.zeros_like(heads.codes), np.empty((m, STATE), h.dtype)
    outward, outward_codes = heads.classes[:, :STATE], heads.codes[:, :STATE]
    for i in range(0, m, COLUMNS):
        part = slice(i, i + COLUMNS)
        lost, d, d_flat[part] = descent(heads.classes, flat[:, part], cls[part], outward)
        loss, d_classes = loss + lost, d_classes + d
    for f in range(FORMS):
        if bounds[f + 1] > bounds[f]:
            part, own = slice(bounds[f], bounds[f + 1]), slice(heads.bounds[f], heads.bounds[f + 1])
            lost, d_codes[own], d = descent(heads.codes[own], flat[:, part], place[part], outward_codes[own])
            loss += lost
            d_flat[part] += d
    d_flat /= m
    d_states = np.zeros((read.size, STATE), h.dtype)
    d_states[used] = d_flat
    d_states = np.ascontiguousarray(d_states.reshape(*read.shape, STATE).transpose(0, 2, 1))
    g: Params = {"C": d_classes[:, :STATE].T / m, "c": d_classes[:, STATE] / m, "U": np.zeros_like(p["U"]), "u": np.zeros_like(p["u"]), "E": np.zeros_like(p["E"])}
    g["U"][heads.order], g["u"][heads.order] = d_codes[:, :STATE] / m, d_codes[:, STATE] / m

    d_u, d_n, back = np.empty_like(product), np.empty_like(n), np.empty_like(h)
    d_h, some, R = np.zeros_like(h), new.any(axis=1), p["R"]
    rest, slope = np.empty_like(h), np.empty_like(h)
    for k in reversed(range(len(read))):
        d_h += d_states[k]
        (z, r, un), (dz, dr, du_n), dn = product[k].reshape(3, STATE, -1), d_u[k].reshape(3, STATE, -1), d_n[k]
        np.subtract(1, z, out=rest)
        np.multiply(n[k], n[k], out=slope)
        np.subtract(1, slope, out=slope)
        np.multiply(d_h, rest, out=dn)
        dn *= slope
        np.subtract(x[k, :STATE], n[k], out=dz)
        dz *= rest
        d_h *= z
        dz *= d_h
        np.multiply(dn, r, out=du_n)
        np.subtract(1, r, out=dr)
        dr *= un
        dr *= dn
        dr *= 0.5
        d_h += np.matmul(R, d_u[k], out=back)
        if some[k]:
            d_h *= ~new[k]
    to_gates, to_own = np.matmul(x, d_u[:, : 2 * STATE].transpose(0, 2, 1)).sum(axis=0), np.matmul(x[:, STATE:], d_n.transpose(0, 2, 1)).sum(axis=0)
    g["R"] = np.concatenate([to_gates[:STATE], np.matmul(x[:, :STATE], d_u[:, 2 * STATE :].transpose(0, 2, 1)).sum(axis=0)], axis=1)
    g["W"], g["b"] = np.concatenate([to_gates[STATE:-1], to_own[:-1]], axis=1), np.concatenate([to_gates[-1], to_own[-1]])
    d_u[:, 2 * STATE :] = d_n  # the candidate's input is not behind its gate
    codes = read.ravel()
    order = np.argsort(codes.astype(np.int16), kind="stable")
    firsts = np.flatnonzero(np.concatenate(([True], np.diff(codes[order]) > 0)))
    d_e = np.matmul(p["W"], d_u).transpose(1, 0, 2).reshape(EMBED, -1)
    g["E"][codes[order[firsts]]] = np.add.reduceat(np.take(d_e, order, axis=1), firsts, axis=1).T
    return g, after[-1], float(loss) / m


class Trainer:
    """Adam over windows of STEPS; its moments live on from call to call."""

    def __init__(self, p: Params, output: Output, first: int, clip: float = 1.0) -> None:
        self.flat, self.output, self.first, self.clip = packed(p).astype(np.float32), output, first, clip
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    @property
    def params(self) -> Params:
        return views(self.flat)

    def fit(self, docs: list[np.ndarray], rate: float, lanes: int) -> float:
        """One pass over ``docs``; the mean loss."""
        parts, before = [], []
        for d in docs:
            for i in range(0, len(d), PART):
                parts.append(d[i : i + PART])
                before.append(int(d[i - 1]) if i else self.first)
        read, target, doc = stream(parts, lanes_of(parts, lanes), before)
        new, p = starts(doc), self.params
        h, seen, total = np.zeros((STATE, read.shape[1]), np.float32), 0, 0.0
        for at in range(0, len(read), STEPS):
            part = slice(at, at + STEPS)
            n = int((doc[part] >= 0).sum())
            grads, h, loss = window_gradients(p, self.output, read[part], target[part], doc[part], new[part], h)
            total, seen = total + loss * n, seen + n
            self.step(packed(grads), rate)
        return total / max(seen, 1)

    def step(self, x: np.ndarray, rate: float) -> None:
        x *= np.float32(min(1.0, self.clip / max(float(np.sqrt(x @ x)), 1e-9)))
        self.t += 1
        self.m += np.float32(0.1) * (x - self.m)
        x *= x
        self.v += np.float32(0.001) * (x - self.v)
        down = np.sqrt(self.v)
        down += np.float32(1e-8)
        self.flat -= np.float32(rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)) * self.m / down
