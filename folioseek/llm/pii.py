"""Personal data: base rules, and a character-level bidirectional LSTM with a CRF.

The base rules name mail and network addresses, card and telephone numbers by
their exact form. The model finds the same things in forms that the rules miss:
`name [at] host dot com`, `10 . 0 . 0 . 7`, a telephone number without its plus.
It is trained in numpy from labelled spans: what the base rules find in a
bounded sample of texts (and SEEDS, so that no kind is without), as it stands
and rewritten in such forms, set into places of those texts. A tag per
character is decoded by Viterbi's algorithm over LSTM emissions and CRF
transitions. The cells squash by x / (1 + |x|), several times faster in numpy than
the hyperbolic tangent and no worse here.

All texts are read whole, in overlapping windows. What the windows of a text
propose is reconciled over the whole text: proposals of one kind that meet are
joined, those on a base span give way to it, and of the others the set without
overlaps that has the greatest total score stays (weighted interval scheduling).
An exact check follows: the span, its marks written plainly, must have its
kind's form (four parts up to 255, Luhn's sum, and so on). Its kind then has the
name of the base kind after `near_`.

Numpy does all windows of a chunk at once, one character after another; memory
is bounded by the chunk and one text. The model is some thousand numbers.

Cases: null and empty texts have no spans; repeated rows and ids get a row each;
an empty table gives no rows (and the model of the seeds alone); other columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
NEAR = tuple(f"near_{kind}" for kind in KINDS)
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"

# Characters of a window, those that two windows share, and windows done at once.
WINDOW, SHARED, CHUNK = 512, 48, 2048
# Characters of a training window, and cells of each direction.
TRAINED, CELLS = 112, 8

# Base rules

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The first digit of a run begins a match or none does: later ones go on alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def _is_card(text: str) -> bool:
    digits = "".join(_DIGITS.findall(text))
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part reaches back to the match before at most."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base rules find, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m[0])]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 11 and _is_card(m[0])]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found)


# Checks of what the model proposes

_AT = re.compile(r"\s*(?:@|[\[({<]\s*(?:at|@)\s*[\])}>]|(?<=\s)at(?=\s))\s*", re.IGNORECASE)
_DOT = re.compile(r"\s*(?:\.|[\[({<]\s*(?:dot|\.)\s*[\])}>]|(?<=\s)dot(?=\s))\s*", re.IGNORECASE)
_PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_PLAIN_IP = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_GROUPED = re.compile(r"[0-9]{4}(?:[ ./_\xb7-]{1,3}[0-9]{4}){2}[ ./_\xb7-]{1,3}[0-9]{1,7}")
_CALL = re.compile(
    r"(?:00[1-9][0-9]{0,2}|\+?[0-9]{0,3})[ ./\xb7-]{0,2}"
    r"(?:\([0-9]{2,5}\)[ ./\xb7-]{0,2}[0-9]{2,5}[ ./\xb7-]{1,2}[0-9]{2,5}|[0-9]{3}[./\xb7-][0-9]{3}[./\xb7-][0-9]{4})"
)


def has_form(kind: int, text: str) -> bool:
    """Whether a proposed span, written plainly, is of its kind."""
    if kind == 0:
        plain = _DOT.sub(".", _AT.sub("@", text, count=1))
        return _PLAIN_EMAIL.fullmatch(plain) is not None
    if kind == 1:
        plain = _DOT.sub(".", text)
        return _PLAIN_IP.fullmatch(plain) is not None and _is_ip(plain)
    if kind == 2:
        return _GROUPED.fullmatch(text) is not None and _is_card(text)
    return _CALL.fullmatch(text) is not None and 9 <= len(_DIGITS.findall(text)) <= 15


# Characters

_MARKS = " \n\t.,;:!?@+-_%()[]{}<>/\\|&*$#=\"'~^`"


def _class_table() -> np.ndarray:
    """Class of each character below 128: the letters, one class for digits, each mark."""
    table = np.full(129, 1, np.uint8)
    table[ord("0") : ord("9") + 1] = 2
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 3 + i
    for i, mark in enumerate(_MARKS):
        table[ord(mark)] = 29 + i
    return table


_TABLE = _class_table()
# Class 0 fills windows up, 1 is any other character.
CLASSES = 29 + len(_MARKS)


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, 128)]


# Training windows

# Labelled spans for kinds that a sample may lack: reserved names, numbers and test cards.
SEEDS = (
    ("jane.doe7@mail.example.com", "info@example.org", "o_brien+x@site-9.example.net"),
    ("192.0.2.14", "198.51.100.230", "203.0.113.5"),
    ("4111111111111111", "5500 0000 0000 0004", "4012-8888-8888-1881"),
    ("+1 (212) 555-0147", "+44 20 7946 0958", "+49-30-5550199"),
)
# What looks alike and is none of the kinds.
LOOKALIKES = (
    "version 3.14.15", "on 2024-01-05 at 10:45:30", "the dot at the end", "0595765", "1,234,567.89", "pp. 12-19",
    "look at example", "@name", "a+b=c", "token = \"59ea3612aa6fdb1d4556\"", "1 2 3 4 5", "ISBN 978-3-16", "50%%%",
    "=== 10.5 ===", "1999-2004", "no. 123 456", "x[3].y[4]", "c++ 11", "(12) see (13)", "at 5 dot 30",
)


def _new_digits(text: str, rng: Random) -> str:
    return "".join(str(rng.randrange(10)) if c.isdigit() else c for c in text)


def _new_letters(text: str, rng: Random) -> str:
    return "".join(chr(97 + rng.randrange(26)) if c.isalpha() and rng.random() < 0.5 else c for c in text)


def rewritten(kind: int, text: str, rng: Random) -> str:
    """A labelled span with new letters and digits, half the time in a form that the rules miss."""
    plain = rng.random() < 0.5
    if kind == 0:
        local, _, domain = text.partition("@")
        local, domain = _new_digits(_new_letters(local, rng), rng), _new_letters(domain, rng)
        if plain:
            return f"{local}@{domain}"
        at = rng.choice([" @ ", " at ", " [at] ", "[at]", "(at)", " (at) ", " AT ", "{at}"])
        dot = rng.choice([".", " . ", " dot ", " [dot] ", "[dot]", "(dot)", " (dot) ", "[.]"])
        return local + at + domain.replace(".", dot)
    if kind == 1:
        text = ".".join(str(rng.randrange(256)) for _ in range(4))
        return text if plain else text.replace(".", rng.choice([" . ", "[.]", " dot ", "(.)", ". ", " [.] ", "[dot]"]))
    if kind == 2:
        digits = "".join(_DIGITS.findall(_new_digits(text, rng)))
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return rng.choice(["", " ", "-"] if plain else [".", "/", "  ", " - ", "_", " / "]).join(groups)
    text = _new_digits(text, rng)
    if plain:
        return text
    bare = _new_digits(rng.choice(["(555) 555-0100", "555-555-0100", "555.555.0100", "1 (555) 555-0100"]), rng)
    return rng.choice([bare, "00" + str(rng.randrange(1, 99)) + " (555) 555-0100", "+" + text[1:].replace("-", "/")])


def training_set(
    windows: list[tuple[str, list]], count: int, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags (0: none) of `count` windows with labelled spans set into them."""
    rng = Random(seed)
    spans = [[text[s:e] for text, found in windows for s, k, e in found if k == kind] for kind in range(len(KINDS))]
    spans = [own + list(seeds) for own, seeds in zip(spans, SEEDS, strict=True)]
    places = [text for text, found in windows if not found] or ["some words stand here and there, and no more of them. "]
    x, y = np.zeros((count, TRAINED), np.uint8), np.zeros((count, TRAINED), np.int8)
    for n in range(count):
        text = rng.choice(places)
        cut = rng.randrange(len(text) + 1)
        pieces: list[tuple[int, str]] = [(0, text[:cut][-rng.randrange(1, TRAINED) :])]
        for _ in range(rng.choice((0, 1, 1, 2))):
            kind = rng.randrange(len(KINDS))
            pieces += [(0, rng.choice((" ", " ", "\n", ": ", ", ", "(", " | "))), (kind + 1, rewritten(kind, rng.choice(spans[kind]), rng))]
        if rng.random() < 0.4:
            pieces += [(0, " " + _new_digits(rng.choice(LOOKALIKES), rng))]
        pieces += [(0, rng.choice((" ", " ", ". ", ", ", "\n", "%%% ", ") ")) + text[cut:])]
        joined = "".join(p for _, p in pieces)
        tags = np.concatenate([np.full(len(p), k, np.int8) for k, p in pieces])
        # Windows end anywhere, also inside a span.
        shift = rng.randrange(max(1, min(len(joined) - 20, len(pieces[0][1]) + 20)))
        own = classes_of(joined)[shift : shift + TRAINED]
        x[n, : len(own)], y[n, : len(own)] = own, tags[shift : shift + TRAINED]
        if rng.random() < 0.2:
            # Some end early, as texts do.
            end = rng.randrange(20, TRAINED)
            x[n, end:], y[n, end:] = 0, 0
    return x, y


# The model

@dataclass
class Model:
    """Weights: of characters and cells for both directions, emissions, transitions."""

    weights: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(step, tag, window) scores of windows of classes."""
        steps, n = x.shape[1], len(x)
        w = {k: v.astype(np.float32) for k, v in self.weights.items()}
        by_step = np.ascontiguousarray(x.T).astype(np.intp)
        scores = w["bias"][:, None]
        z, more = np.empty((2, 4, n, CELLS), np.float32)
        squashed, gates, (i, f, o, g) = np.empty((n, CELLS), np.float32), z[:3], z
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            weights = w["in_" + side], w["cell_" + side]
            enter, cells = (np.ascontiguousarray(m.reshape(-1, 4, CELLS).swapaxes(0, 1)) for m in weights)
            h, c = np.zeros((steps, n, CELLS), np.float32), np.zeros((n, CELLS), np.float32)
            before = np.zeros((n, CELLS), np.float32)
            for t in order:
                np.take(enter, by_step[t], axis=1, out=z, mode="clip")
                np.matmul(before, cells, out=more)
                z += more
                np.abs(z, out=more)
                more += 1
                z /= more
                gates *= 0.5
                gates += 0.5
                c *= f
                i *= g
                c += i
                np.abs(c, out=squashed)
                squashed += 1
                before = np.divide(c, squashed, out=h[t])
                before *= o
            scores = scores + w["out_" + side].T @ h.transpose(0, 2, 1)
        filled = np.zeros(len(w["bias"]), np.float32)
        filled[1:] = -1000
        scores.transpose(0, 2, 1)[by_step == 0] = filled
        return scores

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tags (window, step) by Viterbi's algorithm.

        Windows whose best path is no better than that without any tag need no way back.
        """
        steps, tags, n = scores.shape
        moves = self.weights["moves"].astype(np.float32)
        best, none = scores[0].copy(), scores[0, 0].copy()
        through, top = np.empty(n, np.float32), np.empty((tags, n), np.float32)
        for t in range(1, steps):
            for tag in range(tags):
                np.add(best[0], moves[0, tag], out=top[tag])
                for source in range(1, tags):
                    np.add(best[source], moves[source, tag], out=through)
                    np.maximum(top[tag], through, out=top[tag])
            np.add(top, scores[t], out=best)
            none += scores[t, 0] + moves[0, 0]
        out = np.zeros((n, steps), np.int8)
        marked = np.flatnonzero(best.max(axis=0) > none + 1e-3)
        if len(marked):
            out[marked] = self._traced(np.ascontiguousarray(scores[:, :, marked]), moves)
        return out

    @staticmethod
    def _traced(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
        steps, tags, n = scores.shape
        back = np.empty((steps, tags, n), np.int8)
        best = scores[0]
        for t in range(1, steps):
            through = best[:, None, :] + moves[:, :, None]
            back[t] = through.argmax(axis=0)
            best = through.max(axis=0) + scores[t]
        out, rows = np.empty((n, steps), np.int8), np.arange(n)
        out[:, -1] = best.argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t, out[:, t], rows]
        return out


def _start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    tags = len(KINDS) + 1
    w = {"bias": np.zeros(tags), "moves": np.eye(tags)}
    for side in "fb":
        w["in_" + side] = rng.normal(0, 0.3, (CLASSES, 4 * CELLS))
        # Cells remember at first.
        w["in_" + side][:, CELLS : 2 * CELLS] += 1.0
        # Closed gates: what fills a window up leaves no state, however much of it there is.
        w["in_" + side][0, : 3 * CELLS] = -1e30
        w["cell_" + side] = rng.normal(0, 0.3, (CELLS, 4 * CELLS))
        w["out_" + side] = rng.normal(0, 0.3, (CELLS, tags))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _squashed(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _run_cells(w: dict, side: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """What every step of one direction computes, in running order."""
    n, steps = x.shape
    cells = w["cell_" + side]
    gates = w["in_" + side][x.T if side == "f" else x.T[::-1]]
    h, c = np.zeros((2, steps + 1, n, CELLS), gates.dtype)
    squashed = np.empty((steps, n, CELLS), gates.dtype)
    for t in range(steps):
        z = gates[t]
        z += h[t] @ cells
        z /= 1 + np.abs(z)
        z[:, : 3 * CELLS] = 0.5 * z[:, : 3 * CELLS] + 0.5
        i, f, o, g = (z[:, k : k + CELLS] for k in range(0, 4 * CELLS, CELLS))
        c[t + 1] = f * c[t] + i * g
        squashed[t] = _squashed(c[t + 1])
        h[t + 1] = o * squashed[t]
    return {"gates": gates, "h": h, "c": c, "squashed": squashed}


def _back_cells(w: dict, side: str, x: np.ndarray, run: dict, d_out: np.ndarray, grad: dict) -> None:
    """The gradients of one direction's weights; `d_out` is that of the emissions, step by step."""
    n, steps = x.shape
    if side == "b":
        d_out, x = d_out[::-1], x[:, ::-1]
    gates, h, c, squashed = run["gates"], run["h"], run["c"], run["squashed"]
    i, f, o, g = (gates[:, :, k : k + CELLS] for k in range(0, 4 * CELLS, CELLS))
    # Factors that need no gradient of a later step.
    slope_i, slope_f, slope_o = (0.5 * (1 - np.abs(2 * gate - 1)) ** 2 for gate in (i, f, o))
    from_c = np.concatenate([g * slope_i, c[:-1] * slope_f, i * (1 - np.abs(g)) ** 2], axis=2)
    to_c, to_o = o * (1 - np.abs(squashed)) ** 2, squashed * slope_o
    d_h = d_out @ w["out_" + side].T
    dz = np.empty_like(gates)
    dh_next = dc_next = np.zeros((n, CELLS), gates.dtype)
    back = w["cell_" + side].T
    for t in range(steps - 1, -1, -1):
        dh = d_h[t] + dh_next
        dc = dh * to_c[t] + dc_next
        three = np.concatenate([dc, dc, dc], axis=1) * from_c[t]
        dz[t, :, : 2 * CELLS] = three[:, : 2 * CELLS]
        dz[t, :, 2 * CELLS : 3 * CELLS] = dh * to_o[t]
        dz[t, :, 3 * CELLS :] = three[:, 2 * CELLS :]
        dh_next, dc_next = dz[t] @ back, dc * f[t]
    flat = dz.reshape(-1, 4 * CELLS)
    letters = (x.T.reshape(-1, 1) == np.arange(CLASSES)).astype(np.float32)
    grad["in_" + side] = letters.T @ flat
    grad["in_" + side][0] = 0
    grad["cell_" + side] = h[:-1].reshape(-1, CELLS).T @ flat
    grad["out_" + side] = h[1:].reshape(-1, CELLS).T @ d_out.reshape(-1, d_out.shape[2])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradient(w: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Negative log-likelihood of the tags per window, and its gradient."""
    n, steps = x.shape
    kept = {side: _run_cells(w, side, x) for side in "fb"}
    scores = w["bias"] + kept["f"]["h"][1:] @ w["out_f"] + kept["b"]["h"][:0:-1] @ w["out_b"]
    moves = w["moves"]
    ahead = [scores[0]]
    for t in range(1, steps):
        ahead.append(scores[t] + _log_sum(ahead[-1][:, :, None] + moves, axis=1))
    behind = [np.zeros_like(scores[0])]
    for t in range(steps - 1, 0, -1):
        behind.append(_log_sum(moves + (scores[t] + behind[-1])[:, None, :], axis=2))
    behind.reverse()
    total = _log_sum(ahead[-1], axis=1)
    rows, at = np.arange(n), np.arange(steps)[:, None]
    gold = scores[at, rows, y.T].sum(axis=0) + moves[y[:, :-1], y[:, 1:]].sum(axis=1)
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    d_out = np.stack([np.exp(a + b - total[:, None]) for a, b in zip(ahead, behind, strict=True)])
    d_out[at, rows, y.T] -= 1
    d_out /= n
    for t in range(1, steps):
        both = ahead[t - 1][:, :, None] + moves + (scores[t] + behind[t])[:, None, :]
        grad["moves"] += np.exp(both - total[:, None, None]).sum(axis=0) / n
    np.add.at(grad["moves"], (y[:, :-1], y[:, 1:]), -1 / n)
    grad["bias"] = d_out.sum(axis=(0, 1))
    for side in "fb":
        _back_cells(w, side, x, kept[side], d_out, grad)
    return float((total - gold).mean()), grad


def train(x: np.ndarray, y: np.ndarray, rounds: int = 20, size: int = 128, rate: float = 0.04, seed: int = 0) -> Model:
    """Adam over shuffled batches, its rate falling to nothing."""
    rng = np.random.default_rng(seed)
    w = _start_weights(rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step, steps = 0, rounds * max(1, len(x) // size)
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x) - size + 1, size):
            step += 1
            rows = order[a : a + size]
            _, grad = loss_and_gradient(w, x[rows], y[rows])
            length = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / max(length, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                rise = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                w[k] = w[k] - rate * (1 - (step - 1) / steps) * rise
    return Model(w)


# Decoding and reconciling

def _cut(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts, and the text and place each one begins at."""
    step = WINDOW - SHARED
    text, place = [], []
    for i, own in enumerate(classes):
        starts = np.arange(0, max(len(own) - SHARED, 1), step) if len(own) else np.zeros(0, np.int64)
        text.append(np.full(len(starts), i))
        place.append(starts)
    text, place = np.concatenate(text), np.concatenate(place)
    # One place more than a window has, so that each one ends with what fills it up.
    x = np.zeros((len(text), WINDOW + 1), np.uint8)
    for n, (i, at) in enumerate(zip(text.tolist(), place.tolist(), strict=True)):
        own = classes[i][at : at + WINDOW]
        x[n, : len(own)] = own
    return x, text, place


def _proposed(model: Model, x: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(window, kind, start, end, score) of the stretches with one tag in all windows."""
    sizes = (x > 0).sum(axis=1)
    # Windows of like sizes go together, so that few are filled up.
    order = np.argsort(-sizes, kind="stable")
    for a in range(0, len(x), CHUNK):
        rows = order[a : a + CHUNK]
        own_x = x[rows, : sizes[rows[0]] + 1]
        scores = model.emissions(own_x)
        tags = model.decode(scores)
        tags[own_x == 0] = 0
        marked = np.flatnonzero(tags.any(axis=1))
        for n in marked.tolist():
            own = tags[n]
            edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                kind = int(own[s])
                if kind:
                    gain = float((scores[s:e, kind, n] - scores[s:e, 0, n]).sum())
                    yield int(rows[n]), kind - 1, s, e, gain


def reconciled(
    text: str, base: list[tuple[int, int, int]], proposed: list[tuple[int, int, int, float]]
) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the model adds to the base spans of one text.

    `proposed` are (kind, start, end, score) in the text's own places.
    """
    joined: list[list] = []
    for kind, s, e, score in sorted(proposed):
        if joined and joined[-1][0] == kind and s <= joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], e)
            joined[-1][3] = max(joined[-1][3], score)
        else:
            joined.append([kind, s, e, score])
    fits = []
    for kind, s, e, score in joined:
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while s < e and not text[e - 1].isalnum():
            e -= 1
        # To the edges of words.
        while s < e and s > 0 and (text[s - 1].isalnum() or text[s - 1] in "+("):
            s -= 1
        while s < e < len(text) and text[e].isalnum():
            e += 1
        if score > 0 and not any(s < b and a < e for a, _, b in base) and has_form(kind, text[s:e]):
            fits.append((e, s, kind, score))
    fits.sort()
    ends = [e for e, *_ in fits]
    best: list[tuple[float, list]] = [(0.0, [])]
    for n, (e, s, kind, score) in enumerate(fits):
        before = best[bisect_right(ends, s, hi=n)]
        take = (before[0] + score, [*before[1], (s, kind, e)])
        best.append(max(best[-1], take, key=lambda b: b[0]))
    return best[-1][1]


def added_spans(model: Model, texts: list[str], base: list[list]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the model adds in each text."""
    x, text_of, place = _cut([classes_of(t) for t in texts])
    proposed: list[list] = [[] for _ in texts]
    for n, kind, s, e, score in _proposed(model, x):
        at = int(place[n])
        proposed[text_of[n]].append((kind, at + s, at + e, score))
    return [reconciled(t, b, p) if p else [] for t, b, p in zip(texts, base, proposed, strict=True)]


def _scan(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights)
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                rows = []
                for own, more in zip(base, added_spans(model, texts, base), strict=True):
                    spans = [(s, k, e) for s, k, e in own] + [(s, k + len(KINDS), e) for s, k, e in more]
                    names = KINDS + NEAR
                    rows.append([{"kind": names[k], "start": s, "end": e} for s, k, e in sorted(spans)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, struct)], ["id", "spans"])

    return run


def _examples(per_text: int):
    """Windows around base spans, and some without any: text and spans (start, kind, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.list_(pa.int64()))
        for batch in batches:
            texts, rows = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                for s, k, e in spans[:per_text]:
                    at = max(0, s - TRAINED // 2)
                    texts.append(text[at : e + TRAINED // 2])
                    rows.append([[s - at, k, e - at]])
                free = [s for s in range(0, len(text or ""), TRAINED)][: 4 * per_text]
                for s in free[:: max(1, len(free) // per_text)]:
                    piece = text[s : s + TRAINED]
                    # Numbers that fail a base check may be anything; no example is made of them.
                    if not any(a < s + TRAINED and s < b for a, _, b in spans) and not _CARD.search(piece):
                        texts.append(piece)
                        rows.append([])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(rows, struct)], ["text", "spans"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", texts: int = 1500, per_text: int = 4, windows: int = 4000) -> Model:
    """A model of at most `texts` texts, those with the least hashes of their ids, and `windows` training windows."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(id_col, "text").alias("order"))
    rows = rows.filter("text IS NOT NULL")
    # One number; texts are read again rather than sorted.
    bound = rows.select("order").orderBy("order").limit(texts).agg(F.max("order")).first()[0]
    sample = rows.filter(F.col("order") <= (0 if bound is None else bound)).limit(texts).select("text")
    # One task trains on what is bounded by texts and per_text; the weights are some thousand numbers.
    found = sample.mapInArrow(_examples(per_text), "text string, spans array<array<bigint>>").coalesce(1)
    rows = found.mapInArrow(_train(windows), "name string, rows int, numbers array<float>").collect()
    if not rows:
        return train(*training_set([], windows))
    return Model({r.name: np.array(r.numbers, np.float32).reshape(r.rows, -1).squeeze() for r in rows})


def _train(windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.append((text, [tuple(s) for s in spans]))
        weights = train(*training_set(sorted(found), windows)).weights
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(weights)),
                pa.array([len(v) for v in weights.values()], pa.int32()),
                pa.array([v.ravel() for v in weights.values()], pa.list_(pa.float32())),
            ],
            ["name", "rows", "numbers"],
        )

    return run


def find_spans(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id_col and `spans` (kind, start, end; by start, then kind) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(model.weights), f"id long, spans {SPANS}").withColumnRenamed("id", id_col)
