"""A small causal self-attention model over subword ids, in numpy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Tokens scored together, and tokens before them that they may look back on as well.
BLOCK = 16
WIDTH = 16
SINGLE, SHARED = 96, 32
BATCH, STEPS, RATE = 256, 800, 0.02
FAR = -1e9
KEPT_BYTES = 12 << 20
# exp() of numbers within this of zero, and sums of them, stay in the range of 32-bit floats.
SAFE = 80.0
# Rows scored at once, and tokens whose logits are held at once: few enough for the cache.
ROWS, TOKENS = 256, 256
# Exponents are powers of two, the fastest ones there are.
LOG2E = np.float32(np.log2(np.e))
LOST = np.float32(-100)


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every id, and log10 of its probability within the class.

    The most frequent ids are classes of their own, the others are dealt into classes of about
    equal weight, by falling count. Every id has a positive probability.
    """
    order = np.argsort(-counts, kind="stable")
    weight = counts.astype(float) + 1.0
    rest = order[SINGLE:]
    heap = np.cumsum(weight[rest])
    of = np.zeros(len(counts), np.int32)
    of[order[:SINGLE]] = np.arange(min(SINGLE, len(order)))
    if len(rest):
        of[rest] = SINGLE + np.minimum(SHARED - 1, (SHARED * (heap - weight[rest]) / heap[-1]))
    total = np.bincount(of, weight, SINGLE + SHARED)
    return of, np.log10(weight / total[of]).astype(np.float32)


@dataclass
class Model:
    """Tables of query, key, value and own vector per id, distance biases, output layer."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    own: np.ndarray
    distance: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    of: np.ndarray
    within: np.ndarray
    start: int

    def parameters(self) -> list[np.ndarray]:
        return [
            self.query, self.key, self.value, self.own, self.distance, self.out, self.bias
        ]

    def mask(self) -> np.ndarray:
        """Bias of each of the 2 * BLOCK keys for each query; later tokens are out of sight."""
        return np.where(_BACK >= 0, self.distance[np.clip(_BACK, 0, 2 * BLOCK - 1)], FAR).astype(
            np.float32
        )

    def score(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 probability of each target, in batches of rows.

        ``inputs`` is rows of BLOCK ids; the row before is the context of a row, so a text has to
        begin with a row of start ids. Windows of two rows overlap by one, and only their second
        row is scored, so every token is scored once, with at least BLOCK tokens of context.
        The first row gets zeros.
        """
        keep_memory()
        scores = np.zeros(inputs.shape, np.float32)
        for at in range(1, len(inputs), ROWS):
            last = min(len(inputs), at + ROWS)
            scores[at:last] = self._batch(inputs[at - 1 : last], targets[at:last])
        return scores

    def _batch(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        ids = inputs[1:]
        key, value = self.key.take(inputs, axis=0), self.value.take(inputs, axis=0)
        turned = np.empty((len(ids), WIDTH, 2 * BLOCK), np.float32)
        turned[..., :BLOCK] = key[:-1].transpose(0, 2, 1)
        turned[..., BLOCK:] = key[1:].transpose(0, 2, 1)
        weights, sums = _attended(self.query.take(ids, axis=0), turned, self.mask())
        hidden = np.matmul(weights[..., :BLOCK], value[:-1])
        hidden += np.matmul(weights[..., BLOCK:], value[1:])
        hidden /= sums
        hidden += self.own.take(ids, axis=0)
        np.maximum(hidden, 0, out=hidden)
        goal = targets.ravel()
        output = _Output(hidden.reshape(-1, WIDTH), self.out, self.bias, self.of.take(goal))
        scores = np.empty(len(goal), np.float32)
        total = np.empty(len(goal), np.float32)
        for at in range(0, len(goal), TOKENS):
            tokens = slice(at, at + TOKENS)
            p = output.logits(tokens)
            p.ravel().take(output.places[tokens], out=scores[tokens], mode="clip")
            np.matmul(output.powers(p), output.scale, out=total[tokens])
        scores -= np.log2(total)
        scores *= np.float32(np.log10(2))
        scores += np.log10(output.own_scale)
        scores += self.within.take(goal)
        return scores.reshape(ids.shape)


_BACK = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
_DISTANCE = np.clip(_BACK, 0, None).ravel()
_ONES = np.ones(SINGLE + SHARED, np.float32)


def keep_memory() -> None:
    """Let the allocator keep what one step frees for the next, instead of asking for new pages.

    glibc serves sizes up to the largest freed piece so far from memory it holds, and gives that
    back beyond twice as much. The piece is never written to, so it takes up no memory itself.
    """
    np.empty(KEPT_BYTES, np.uint8)


def _attended(query, turned, mask) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights that are not divided by their sums yet, and those sums.

    ``turned`` has the keys as columns. Rows are shifted by their maximum only where exp could
    leave the range of its type.
    """
    weights = np.matmul(query * LOG2E, turned)
    reach = max(weights.max(initial=0), -weights.min(initial=0)) / LOG2E
    if reach + np.abs(mask[mask > FAR]).max() <= SAFE:
        np.exp2(weights, out=weights)
        weights *= np.exp(mask)
    else:
        weights += mask * LOG2E
        weights -= weights.max(axis=2, keepdims=True)
        np.exp2(weights, out=weights)
    sums = weights.reshape(-1, 2 * BLOCK) @ _ONES[: 2 * BLOCK]
    return weights, sums.reshape(*query.shape[:2], 1)


class _Output:
    """The output layer over hidden rows, a few tokens at a time in one piece of memory.

    Logits are to the base of two and come without the biases, whose exponents are ``scale``, a
    factor of each class; only biases that are too far apart for that are in the logits. Rows are
    shifted by their maximum where exp could leave the range of its type. ``own`` are classes, and
    ``places`` where theirs lie among the logits.
    """

    def __init__(self, hidden: np.ndarray, out: np.ndarray, bias: np.ndarray, own: np.ndarray):
        apart = bias - (bias.max() + bias.min()) / 2
        room = SAFE - 2 * np.abs(apart).max()
        self.far_apart = bool(room < SAFE / 4)
        self.scale = _ONES if self.far_apart else np.exp(apart)
        self.room = np.float32(-1 if self.far_apart else room * LOG2E)
        self.own_scale = self.scale.take(own)
        self.hidden, self.out, self.bias = hidden, out * LOG2E, bias * LOG2E
        # No logit of a row is beyond the product of the lengths.
        longest = np.square(self.out).sum(axis=0).max()
        self.reach = np.sqrt(np.square(hidden) @ _ONES[:WIDTH] * longest)
        # Where no row can leave the range, the logits are not looked at.
        begins = np.arange(0, len(hidden), TOKENS)
        self.safe = (np.maximum.reduceat(self.reach, begins) <= self.room).tolist()
        self.held = np.empty((min(TOKENS, len(hidden)), len(bias)), np.float32)
        self.places = _begins(len(own), len(bias)) + own

    def logits(self, tokens: slice) -> np.ndarray:
        hidden = self.hidden[tokens]
        p = np.matmul(hidden, self.out, out=self.held[: len(hidden)])
        if self.far_apart:
            p += self.bias
        self.shifted = ()
        if self.safe[tokens.start // TOKENS]:
            return p
        if not (p.max(initial=0) <= self.room and -p.min(initial=0) <= self.room):
            self.shifted = np.flatnonzero(~(self.reach[tokens] <= self.room))
            rows = p.take(self.shifted, axis=0)
            rows -= rows.max(axis=1, keepdims=True)
            p[self.shifted] = rows
        return p

    def powers(self, p: np.ndarray) -> np.ndarray:
        """The exponents of the last logits, in their place."""
        if len(self.shifted):
            # What is lost beside the one of the maximum takes exp2 longest.
            p[self.shifted] = np.maximum(p.take(self.shifted, axis=0), LOST)
        return np.exp2(p, out=p)


@lru_cache(maxsize=8)
def _begins(rows: int, width: int) -> np.ndarray:
    """Where each of so many rows begins in the piece of memory that holds TOKENS of them."""
    return np.arange(rows) % TOKENS * width


def placed(
    ids: np.ndarray, sizes: np.ndarray, start: int, end: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of inputs and of targets of texts that lie one after the other in ``ids``.

    Also the flat place of every id, and of the end of every text. A text begins with a row of
    start ids and fills whole rows.
    """
    rows = 1 + -(-(sizes + 1) // BLOCK)
    first = (np.cumsum(rows) - rows + 1) * BLOCK
    length = int(rows.sum()) * BLOCK
    inputs = np.full(length, start, np.int32)
    targets = np.full(length, end, np.int32)
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
    inputs[at + 1] = ids
    targets[at] = ids
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), at, first + sizes


def layout(texts: list[np.ndarray], start: int, end: int) -> tuple[np.ndarray, ...]:
    """Rows of inputs and of targets of several texts, and the text of each target (-1: none)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.concatenate([*texts, np.zeros(0, np.int64)])
    inputs, targets, at, ends = placed(ids, sizes, start, end)
    owner = np.full(inputs.size, -1, np.int64)
    owner[at] = np.repeat(np.arange(len(texts)), sizes)
    owner[ends] = np.arange(len(texts))
    return inputs, targets, owner.reshape(-1, BLOCK)


def untrained(counts: np.ndarray, start: int) -> Model:
    """The class shares alone; tables and output layer are small seeded noise."""
    of, within = classes(counts)
    draw = np.random.default_rng(7)

    def table(shape, scale):
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    share = np.bincount(of, counts + 1.0, SINGLE + SHARED)
    return Model(
        *[table((len(counts), WIDTH), 0.1) for _ in range(4)],
        np.zeros(2 * BLOCK, np.float32),
        table((WIDTH, SINGLE + SHARED), 0.1),
        np.log(np.maximum(share, 1e-9) / share.sum()).astype(np.float32),
        of, within, start,
    )


def fit(
    model: Model,
    windows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
    steps: int,
    seed: list[int],
    done: float = 0.0,
    share: float = 1.0,
) -> None:
    """Adam on ``model`` itself, over ids, ids before, targets and target weights of windows.

    Every window is taken once before any is taken again. The rate falls linearly over the whole
    training, of which this is a ``share`` that begins after ``done``.
    """
    keep_memory()
    ids, before, targets, weight = windows
    draw = np.random.default_rng(seed)
    order, at_row = draw.permutation(len(ids)), 0
    # Tables that are read at the same ids lie side by side.
    tables = [
        np.concatenate([model.query, model.own], axis=1),
        np.concatenate([model.key, model.value], axis=1),
    ]
    dense = [model.distance, model.out, model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in [*tables, *dense]]
    for step in range(1, steps + 1):
        if at_row >= len(order):
            order, at_row = draw.permutation(len(ids)), 0
        rows = order[at_row : at_row + BATCH]
        at_row += BATCH
        grads = _gradients(
            [*tables, *dense], model.mask(), ids[rows], before[rows],
            model.of.take(targets[rows]), weight[rows],
        )
        rate = RATE * (1 - done - share * (step - 1) / steps) / (1 - 0.9**step)
        spread = 1 / np.sqrt(1 - 0.99**step)
        # Rows of ids that a batch lacks keep their moments.
        for p, (m, v), (at, g) in zip(tables, moments[:2], grads[:2], strict=True):
            rows_of = [whole.take(at, axis=0) for whole in (p, m, v)]
            _adam(*rows_of, g, rate, spread)
            p[at], m[at], v[at] = rows_of
        for p, (m, v), g in zip(dense, moments[2:], grads[2:], strict=True):
            _adam(p, m, v, g, rate, spread)
    near, far = tables
    model.query[:], model.own[:] = near[:, :WIDTH], near[:, WIDTH:]
    model.key[:], model.value[:] = far[:, :WIDTH], far[:, WIDTH:]


def _adam(p, m, v, g, rate: float, spread: float) -> None:
    """One step on ``p`` and its moments, all in place; ``g`` is used up."""
    m *= 0.9
    m += np.float32(0.1) * g
    g *= g
    g *= 0.01
    v *= 0.99
    v += g
    np.sqrt(v, out=g)
    g *= spread
    g += 1e-6
    np.divide(m, g, out=g)
    g *= rate
    p -= g


def bound(model: Model) -> None:
    """exp() of an attention weight is taken without a shift: keep it within its range."""
    reach = np.linalg.norm(model.query, axis=1).max() * np.linalg.norm(model.key, axis=1).max()
    reach += np.abs(model.distance).max()
    if reach > 60:
        model.query *= 60 / reach
        model.distance *= 60 / reach


def train(
    texts: list[np.ndarray],
    weights: list[np.ndarray],
    counts: np.ndarray,
    start: int,
    end: int,
    steps: int = STEPS,
) -> Model:
    """A model fitted to ``texts`` in one place; class shares come from ``counts``.

    ``weights`` has the weight of every id of a text and of its end.

    The same texts and counts give the same model. Without texts it is the class shares alone.
    """
    model = untrained(counts, start)
    if not texts:
        return model
    inputs, targets, owner = layout(texts, start, end)
    weight = np.zeros(owner.size, np.float32)
    weight[owner.ravel() >= 0] = np.concatenate(weights)
    weight = weight.reshape(owner.shape)
    rows = np.flatnonzero((owner[1:] >= 0).any(axis=1)) + 1
    fit(model, (inputs[rows], inputs[rows - 1], targets[rows], weight[rows]), steps, [7])
    bound(model)
    return model


def _gradients(params, mask, ids, before, goal, weight) -> list:
    """Gradient of each parameter; ``goal`` is the targets' classes.

    Those of the tables come with the rows they concern.
    """
    near, far, distance, out, bias = params
    seen = np.concatenate([before, ids], axis=1)
    read, known = near.take(ids, axis=0), far.take(seen, axis=0)
    # Products with keys and values turned beforehand are faster than those that turn them.
    turned = np.ascontiguousarray(known.transpose(0, 2, 1))
    q, k, v = read[..., :WIDTH], known[..., :WIDTH], known[..., WIDTH:]
    weights, sums = _attended(q, turned[:, :WIDTH], mask)
    np.divide(1, sums, out=sums)
    found = np.matmul(weights, v)
    found *= sums
    hidden = (found + read[..., WIDTH:]).reshape(-1, WIDTH)
    np.maximum(hidden, 0, out=hidden)
    active = hidden > 0
    output = _Output(hidden, out, bias, goal.ravel())
    share = weight.ravel() / max(1.0, weight.sum())
    back = np.ascontiguousarray((out * output.scale).T)
    g_hidden = np.empty((weight.size, WIDTH), np.float32)
    g_out, g_bias = np.zeros_like(out), np.zeros_like(bias)
    for at in range(0, weight.size, TOKENS):
        tokens = slice(at, at + TOKENS)
        p = output.powers(output.logits(tokens))
        # Rows of ``p`` are left unscaled; what each is multiplied by goes to narrower arrays.
        total, flat, place = p @ output.scale, p.ravel(), output.places[tokens]
        flat[place] = flat.take(place) - total / output.own_scale[tokens]
        share[tokens] /= total
        np.matmul(p, back, out=g_hidden[tokens])
        hidden[tokens] *= share[tokens, None]
        g_out += hidden[tokens].T @ p
        g_bias += share[tokens] @ p
    g_out *= output.scale
    g_bias *= output.scale
    g_hidden *= share[:, None]
    g_hidden *= active
    g_hidden = g_hidden.reshape(found.shape)
    g_near = np.empty((*ids.shape, 2 * WIDTH), np.float32)
    g_near[..., WIDTH:] = g_hidden
    g_hidden *= sums
    g_scores = np.matmul(g_hidden, turned[:, WIDTH:])
    found *= g_hidden
    g_scores -= (found.reshape(-1, WIDTH) @ _ONES[:WIDTH]).reshape(sums.shape)
    g_scores *= weights
    np.matmul(g_scores, k, out=g_near[..., :WIDTH])
    g_far = np.empty((*seen.shape, 2 * WIDTH), np.float32)
    np.matmul(g_scores.transpose(0, 2, 1), q, out=g_far[..., :WIDTH])
    np.matmul(weights.transpose(0, 2, 1), g_hidden, out=g_far[..., WIDTH:])
    by_place = np.ones(len(ids), np.float32) @ g_scores.reshape(len(ids), -1)
    # Weights of later tokens are zero, and so are their gradients.
    g_distance = np.bincount(_DISTANCE, by_place, 2 * BLOCK)
    return [
        _scattered(ids, g_near),
        _scattered(seen, g_far),
        g_distance.astype(np.float32),
        g_out,
        g_bias,
    ]


def _scattered(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the sum of the values of each."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat.take(order)
    begins = np.concatenate([[True], flat[1:] != flat[:-1]])
    first = np.flatnonzero(begins)
    values = values.reshape(-1, 2 * WIDTH)
    sums = values.take(order.take(first), axis=0)
    # Only what follows the first of a row is added up, two numbers at a time as a complex one.
    later = values.take(order[~begins], axis=0).view(np.complex64)
    more = np.flatnonzero(np.diff(first, append=len(flat)) > 1)
    if len(more):
        sums[more] += np.add.reduceat(later, first[more] - more, axis=0).view(np.float32)
    return flat.take(first).astype(np.intp), sums
