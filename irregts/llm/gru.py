"""A gated recurrent network over symbols, in numpy: training and scoring.

Input is one symbol per step: a frequent word or the class of a rarer one. The output softmax
is factored: the class of the next symbol, then, for frequent words, the word in its class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

HIDDEN, CLASS_WORDS, WINDOW = 16, 32, 32
#: Sequences that advance together, states held until their next symbols are scored, and those that
#: a softmax takes at once: what is worked on fits the cache of a core.
TOGETHER, HELD_STATES, BLOCK = 1024, 1 << 13, 512
NAMES = ("table", "recurrent", "class_weight", "class_bias", "word_weight", "word_bias")


@dataclass
class Shape:
    """``words`` frequent words come first among the symbols, in classes of ``CLASS_WORDS``;
    ``classes`` symbols for classes of other words follow."""

    words: int
    classes: int

    @property
    def word_classes(self) -> int:
        return -(-self.words // CLASS_WORDS)

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.words, symbols // CLASS_WORDS, symbols - self.words + self.word_classes)


class Room:
    """Arrays that are filled again and again: memory that is new each time costs as much as the sums."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *size: int) -> np.ndarray:
        n, flat = math.prod(size), self.held.get(name)
        if flat is None or len(flat) < n or flat.dtype != kind:
            flat = self.held[name] = np.empty(n, kind)
        return flat[:n].reshape(size)


class Network:
    """Parameters and the two passes through them."""

    def __init__(self, shape: Shape, parameters: dict[str, np.ndarray]) -> None:
        self.shape, self.parameters, self.room = shape, parameters, Room()

    @classmethod
    def start(cls, shape: Shape, counts: np.ndarray, seed: int = 0) -> Network:
        """Small random weights; biases that give each symbol its share of ``counts``."""
        random = np.random.default_rng(seed)
        n, classes = shape.words + shape.classes, shape.word_classes + shape.classes

        def normal(scale: float, *size: int) -> np.ndarray:
            return (random.standard_normal(size) * scale).astype(np.float32)

        word_counts = np.full((shape.word_classes, CLASS_WORDS), 1e-9)
        word_counts.ravel()[: shape.words] = counts[: shape.words] + 0.5
        of_class = np.bincount(shape.class_of(np.arange(n)), counts + 0.5, classes)
        return cls(
            shape,
            {
                "table": normal(0.3, n, 3 * HIDDEN),
                "recurrent": normal(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN),
                "class_weight": normal(0.05, HIDDEN, classes),
                "class_bias": np.log(of_class / of_class.sum()).astype(np.float32),
                "word_weight": normal(0.05, shape.word_classes, HIDDEN, CLASS_WORDS),
                "word_bias": np.log(word_counts / word_counts.sum(1, keepdims=True)).astype(np.float32),
            },
        )

    def advance(
        self, state: np.ndarray, given: np.ndarray, kept: np.ndarray, gates: np.ndarray, fresh: np.ndarray, ahead: np.ndarray
    ) -> None:
        """Fill ``ahead`` with the next state after inputs ``given``, ``gates`` with the update and
        reset, ``fresh`` and, in the last rows of ``kept``, what the reset acts on. Sequences are
        columns, so that every part of a state lies in one piece."""
        h = HIDDEN
        np.matmul(self.parameters["recurrent"].T, state, out=kept)
        np.add(given[: 2 * h], kept[: 2 * h], out=gates)
        gates *= 0.5  # the logistic function as a hyperbolic tangent
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        np.multiply(gates[h:], kept[2 * h :], out=fresh)
        fresh += given[2 * h :]
        np.tanh(fresh, out=fresh)
        np.subtract(state, fresh, out=ahead)
        ahead *= gates[:h]
        ahead += fresh

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after ``symbols``, the gates, the fresh part and what the reset acts on."""
        h, kind, n = HIDDEN, state.dtype, len(state)
        kept, gates, fresh, ahead = (np.empty((k * h, n), kind) for k in (3, 2, 1, 1))
        self.advance(state.T, self.parameters["table"][symbols].T, kept, gates, fresh, ahead)
        return ahead.T, gates.T, fresh.T, kept[2 * h :].T

    def log_probability(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of each symbol's probability after its state."""
        order = self._in_order(symbols)
        flat = np.ones((HIDDEN + 1, len(order)), states.dtype)
        flat[:HIDDEN] = states[order].T
        out = np.empty(len(order), states.dtype)
        out[order] = self._logs(flat, symbols[order], *self._weights_and_biases())
        return out

    def _in_order(self, symbols: np.ndarray) -> np.ndarray:
        """Places of symbols in ascending order: words by class, then the classes of other words."""
        return np.argsort(symbols.astype(np.min_scalar_type(self.shape.words + self.shape.classes)), kind="stable")

    def _weights_and_biases(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the classes and of the words of each class, the bias being the weight of a last input of one."""
        p = self.parameters
        return (
            np.concatenate([p["class_weight"], p["class_bias"][None]]),
            np.concatenate([p["word_weight"], p["word_bias"][:, None]], axis=1),
        )

    def _class_scores(self, flat: np.ndarray, class_weight: np.ndarray) -> np.ndarray:
        scores = self.room("class_scores", flat.dtype, class_weight.shape[1], flat.shape[1])
        return np.matmul(class_weight.T, flat, out=scores)

    def _word_scores(self, flat: np.ndarray, target: np.ndarray, word_weight: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Scores of the words in the class of each target that is a word, and the columns of each class."""
        classes = len(word_weight)
        ends = np.searchsorted(target, np.minimum(np.arange(classes + 1) * CLASS_WORDS, self.shape.words)).tolist()
        runs = [(c, slice(a, b)) for c, a, b in zip(range(classes), ends, ends[1:]) if a < b]
        scores = self.room("word_scores", flat.dtype, CLASS_WORDS, ends[-1])
        for c, run in runs:
            np.matmul(word_weight[c].T, flat[:, run], out=scores[:, run])
        return scores, runs

    def _exponentials(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take one number off all ``scores`` (one off each column, where some column would
        vanish); their exponentials and the sums of those per column."""
        scores -= scores.max(initial=0)
        powers = np.exp(scores, out=self.room("powers", scores.dtype, *scores.shape))
        sums = powers.sum(axis=0)
        if not (sums > 1e-30).all():
            scores -= scores.max(axis=0)
            np.exp(scores, out=powers)
            sums = powers.sum(axis=0)
        return powers, sums

    def _log_softmax_at(self, scores: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, sums = self._exponentials(scores)
        return scores[at, np.arange(len(at))] - np.log(sums)

    def _softmax_loss(self, scores: np.ndarray, at: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient with respect to the scores (good until the next call), and the loss."""
        powers, sums = self._exponentials(scores)
        columns = np.arange(len(at))
        loss = -float((share * np.log(np.maximum(powers[at, columns] / sums, 1e-30))).sum())
        powers *= share / sums
        powers[at, columns] -= share
        return powers, loss

    def _logs(self, flat: np.ndarray, target: np.ndarray, class_weight: np.ndarray, word_weight: np.ndarray) -> np.ndarray:
        """Log probability of ascending symbols; ``flat`` has the states, then a one, as columns."""
        wanted, out = self.shape.class_of(target), np.empty(len(target), flat.dtype)
        for at in range(0, len(target), BLOCK):
            some = slice(at, at + BLOCK)
            out[some] = self._log_softmax_at(self._class_scores(flat[:, some], class_weight), wanted[some])
        scores, _ = self._word_scores(flat, target, word_weight)
        words = scores.shape[1]
        out[:words] += self._log_softmax_at(scores, target[:words] % CLASS_WORDS)
        return out

    def score(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log probability of whole sequences that lie one after the other in ``symbols``.

        Sequences of like lengths advance together, longest first, so that those that have ended
        drop out at the end; states go from window to window.
        """
        order = np.argsort(-lengths, kind="stable")
        starts, total = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
        table, weights = np.ascontiguousarray(self.parameters["table"].T), self._weights_and_biases()
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            total[some] = self._score(symbols, starts[some], lengths[some], table, weights)
        return total

    def _score(
        self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, weights: tuple[np.ndarray, ...]
    ) -> np.ndarray:
        h, kind, room, longest = HIDDEN, table.dtype, self.room, int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        ends = np.cumsum(active)
        total, state, t = np.zeros(len(sizes)), np.zeros((h, len(sizes)), kind), 0
        while t < longest:
            # Some steps of all sequences that go on: the states one after the other, step by step.
            after = min(longest, int(np.searchsorted(ends, ends[t] - active[t] + HELD_STATES)) + 1)
            widths = active[t:after]
            held = int(widths.sum())
            begins = np.cumsum(widths) - widths
            who = np.arange(held) - np.repeat(begins, widths)
            seen = symbols[starts[who] + np.repeat(np.arange(t, after), widths)]
            given = table.take(seen, axis=1, mode="clip", out=room("given", kind, 3 * h, held))
            states = room("states", kind, h + 1, HELD_STATES + 2 * len(sizes) + 16)
            states[h] = 1
            begin, n, parts = 0, 0, ()
            states[:h, : widths[0]] = state[:, : widths[0]]
            for width in widths.tolist():
                if width != n:
                    n, parts = width, tuple(room(name, kind, k * h, width) for name, k in (("kept", 3), ("gates", 2), ("fresh", 1)))
                end = begin + n
                # Those that end here leave states that the next step's overwrite.
                self.advance(states[:h, begin:end], given[:, begin:end], *parts, states[:h, end : end + n])
                begin = end
            state, t = states[:h, begin : begin + n].copy(), after
            place = self._in_order(seen)
            flat = states[:, :held].take(place, axis=1, mode="clip", out=room("flat", kind, h + 1, held))
            total += np.bincount(who[place], self._logs(flat, seen[place].astype(np.int64), *weights), len(sizes))
        return total

    def gradient(
        self, state: np.ndarray, symbols: np.ndarray, resets: np.ndarray, weight: np.ndarray
    ) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradient of one window (steps x lanes) by truncated backpropagation, the state
        after it and its loss. ``resets`` marks symbols that start a text; ``weight`` is 0
        for padding."""
        p, h, kind, (steps, lanes) = self.parameters, HIDDEN, self.parameters["recurrent"].dtype, symbols.shape
        n, starting = steps * lanes, resets.any(axis=1).tolist()

        def room(name: str, *size: int) -> np.ndarray:
            return self.room(name, kind, *size)

        def rows(name: str, parts: np.ndarray) -> np.ndarray:
            """A row per part. In memory, rows are a little longer than needed, since those that
            are a power of two apart share the same places of the cache."""
            made = room(name, parts.shape[1], n + 16)[:, :n]
            made.reshape(-1, steps, lanes)[:] = parts.transpose(1, 0, 2)
            return made

        given = room("given", steps, 3 * h, lanes)
        taken = p["table"].take(symbols, axis=0, out=room("taken", steps, lanes, 3 * h), mode="clip")
        given[:] = taken.transpose(0, 2, 1)
        states, kept = room("states", steps + 1, h, lanes), room("kept", steps, 3 * h, lanes)
        gates, fresh = room("gates", steps, 2 * h, lanes), room("fresh", steps, h, lanes)
        states[0] = state.T
        for t in range(steps):
            if starting[t]:
                states[t][:, resets[t]] = 0
            self.advance(states[t], given[t], kept[t], gates[t], fresh[t], states[t + 1])
        before, after = states[:-1], np.ascontiguousarray(states[-1].T)

        # The softmax of all steps, in ascending order of symbols; the last input is one.
        order = self._in_order(symbols.ravel())
        target = symbols.ravel()[order]
        share = weight.ravel()[order].astype(np.float32)
        share = share / max(1.0, float(share.sum()))
        past, flat = rows("past", before), room("flat", h + 1, n)
        past.take(order, axis=1, out=flat[:h], mode="clip")
        flat[h] = 1
        class_weight, word_weight = self._weights_and_biases()
        wanted, found = self.shape.class_of(target), np.zeros_like(class_weight)
        sorted_back, loss = room("sorted_back", h, n), 0.0
        for at in range(0, n, BLOCK):
            some = slice(at, at + BLOCK)
            chance, more = self._softmax_loss(self._class_scores(flat[:, some], class_weight), wanted[some], share[some])
            loss += more
            found += flat[:, some] @ chance.T
            np.matmul(p["class_weight"], chance, out=sorted_back[:, some])
        grads = {"class_weight": found[:h], "class_bias": found[h]}
        scores, runs = self._word_scores(flat, target, word_weight)
        words = scores.shape[1]
        chance, more = self._softmax_loss(scores, target[:words] % CLASS_WORDS, share[:words])
        loss += more
        found, word_back = np.zeros_like(word_weight), room("word_back", h, words)
        for c, run in runs:
            np.matmul(flat[:, run], chance[:, run].T, out=found[c])
            np.matmul(p["word_weight"][c], chance[:, run], out=word_back[:, run])
        grads |= {"word_weight": found[:, :h], "word_bias": found[:, h]}
        sorted_back[:, :words] += word_back
        place = np.empty_like(order)
        place[order] = np.arange(n)
        back = sorted_back.take(place, axis=1, out=room("back", h, n), mode="clip").reshape(h, steps, lanes)

        # What a change of the state ahead does to the inputs, for all steps at once: to the fresh
        # part, the update, the reset, and to the fresh part through the reset.
        update, reset, kept = gates[:, :h], gates[:, h:], kept[:, 2 * h :]
        to, left = room("to", steps, 4, h, lanes), room("left", steps, h, lanes)
        to_fresh, to_update, to_reset, through = (to[:, k] for k in range(4))
        np.subtract(1, update, out=left)
        np.multiply(left, update, out=to_update)
        np.subtract(before, fresh, out=to_reset)
        to_update *= to_reset
        fresh *= fresh
        np.subtract(1, fresh, out=to_fresh)
        to_fresh *= left
        np.multiply(to_fresh, reset, out=through)
        np.subtract(1, reset, out=to_reset)
        to_reset *= kept
        to_reset *= through
        changes = room("changes", steps, 1, h, lanes)  # of the state after each step
        ahead, through_gates, gone = np.zeros((h, lanes), kind), np.empty((3, h, lanes), kind), np.empty((h, lanes), kind)
        for t in range(steps - 1, -1, -1):
            changes[t, 0] = ahead
            np.multiply(to[t, 1:], ahead, out=through_gates)
            np.matmul(p["recurrent"], through_gates.reshape(3 * h, lanes), out=gone)
            ahead *= update[t]
            ahead += gone
            ahead += back[:, t]
            if starting[t]:
                ahead[:, resets[t]] = 0
        to *= changes
        inputs = rows("inputs", to.reshape(steps, 4 * h, lanes))
        grads["recurrent"] = past @ inputs[h:].T
        grads["table"] = np.zeros_like(p["table"])
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        inputs = inputs[: 3 * h].take(order, axis=1, out=room("taken", 3 * h, n), mode="clip")
        sums = np.add.reduceat(inputs, first, axis=1).T
        grads["table"][target[first]] = np.concatenate([sums[:, h:], sums[:, :h]], axis=1)
        return {k: grads[k] for k in NAMES}, after, loss


class Adam:
    def __init__(self, network: Network, rate: float) -> None:
        self.network, self.rate, self.steps = network, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in network.parameters.items()}
        self.square = {k: np.zeros_like(v) for k, v in network.parameters.items()}

    def apply(self, grads: dict[str, np.ndarray], clip: float = 1.0) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / max(norm, 1e-12))
        fix = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            mean, square = self.mean[k], self.square[k]
            g = g * np.float32(scale)
            by = g - mean
            by *= np.float32(0.1)
            mean += by
            g *= g
            g -= square
            g *= np.float32(0.001)
            square += g
            np.sqrt(square, out=g)
            g += np.float32(1e-8)
            np.multiply(mean, np.float32(self.rate * fix), out=by)
            by /= g
            self.network.parameters[k] -= by


def train_stream(network: Network, symbols: np.ndarray, starts: np.ndarray, epochs: int, rate: float, lanes: int = 64) -> list[float]:
    """Truncated backpropagation over texts that lie one after the other; ``starts`` marks
    their first symbols. The stream is cut into lanes, the last of which is filled up with symbols
    of weight 0; states go from window to window, a lane that begins inside a text from zero."""
    adam, losses = Adam(network, rate), []
    lanes = max(1, min(lanes, len(symbols) // WINDOW))
    width = -(-len(symbols) // lanes)
    filled = np.zeros(width * lanes, symbols.dtype)
    filled[: len(symbols)] = symbols
    begins = np.zeros(width * lanes, bool)
    begins[: len(symbols)] = starts
    grid, resets = filled.reshape(lanes, width).T, begins.reshape(lanes, width).T
    weight = (np.arange(width * lanes) < len(symbols)).reshape(lanes, width).T
    for _ in range(epochs):
        state = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, width, WINDOW):
            window = slice(at, at + WINDOW)
            grads, state, loss = network.gradient(state, grid[window], resets[window], weight[window])
            adam.apply(grads)
            losses.append(loss)
    return losses
