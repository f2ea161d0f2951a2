"""Personal data by a character-level bidirectional LSTM with a CRF, trained in numpy.

The model is trained from labelled spans: e-mail addresses, telephone numbers, IP addresses,
card numbers, identifiers of persons and accounts, and secrets that a generator sets into invented prose,
beside numbers and words which only look like them. `python -m voxlake.llm.pii` trains it, seeded, and stores its
weights beside this module, from where queries read them; they are small and of a fixed size, and are broadcast.

A text is covered by windows of `WINDOW` characters, each overlapping the next by `OVERLAP`; each character's
emissions come from the window in which it is farther from the edge. The tags, with one for a span's first
character and one for the others, are the best path through all of a text's emissions: Viterbi is run once over the whole
text, but for stretches of which a bound tells that the best path is outside throughout.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm.arrow_text import slices
from voxlake.llm.tables import by_place

KINDS = ("", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID")
#: Of the tags, 0 is outside, k is inside of kind k, and k + FIRST is the first character of kind k.
FIRST = len(KINDS) - 1
TAGS = 1 + 2 * FIRST
HIDDEN, WINDOW, OVERLAP, SYMBOLS = 10, 1024, 128, 128
ROWS = 512
#: Emissions are worked out of so many characters at once, which stay in a core's cache.
BLOCK = 3072
#: The weight that each character's own classification has in training, beside the CRF's likelihood.
ALONE = 0.3
STORED = Path(__file__).with_name("pii_weights.npz")


class Weights(NamedTuple):
    """For each direction: input [symbols, 4 h], recurrent [h, 4 h]; gates in, forget, out, cell."""

    wf: np.ndarray
    uf: np.ndarray
    wb: np.ndarray
    ub: np.ndarray
    out: np.ndarray  # [2 h, tags]
    bias: np.ndarray
    move: np.ndarray  # [tags, tags], from the first to the second


def forbidden() -> np.ndarray:
    """Which moves can't be: a kind's inside follows its first character or itself, and a span has two characters at least."""
    out = np.zeros((TAGS, TAGS), bool)
    out[FIRST + 1 :] = True
    for k in range(1, FIRST + 1):
        out[:, k] = True
        out[[k, k + FIRST], k] = False
    return out


NEVER = np.float32(-1e4)


def codes(text: str) -> np.ndarray:
    """A symbol for each character; those beyond ASCII are one symbol."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(c, 127).astype(np.uint8)


# labelled spans


class Dice:
    """What the generator uses of a numpy random generator, for single numbers many times as fast."""

    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed).random

    def integers(self, low: int, high: int | None = None, size: int | None = None):
        low, high = (0, low) if high is None else (low, high)
        if size is None:
            return low + int(self.random() * (high - low))
        return [low + int(self.random() * (high - low)) for _ in range(size)]


def _word(rng, low: int = 1, high: int = 12) -> str:
    syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "é", "è", "ü", "ß", "ñ", "ó", "ç", "ö", "sch", "ción", "eau", "que", "x", "k", "z", "j", "w", "y")
    out, n = "", rng.integers(low, high + 1)
    any_letters = rng.random() < 0.5
    while len(out) < n:
        if any_letters:  # pairs of any consonant and vowel, and now and then another consonant
            out += "bcdfghjklmnpqrstvwxyz"[rng.integers(21)] + "aeiouaeiouyäöüéáàêíóú"[rng.integers(21)] + ("ngrslmtpfbchkd"[rng.integers(14)] if rng.random() < 0.4 else "")
        else:
            out += syllables[rng.integers(len(syllables))]
    return out


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _pick(rng, *options):
    return options[rng.integers(len(options))]


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _of(rng, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def _grouped(text: str, *sizes: int, by: str = " ") -> str:
    out, at = [], 0
    for n in sizes:
        out.append(text[at : at + n])
        at += n
    return by.join(x for x in [*out, text[at:]] if x)


def _email(rng) -> str:
    name = _pick(rng, _word(rng, 1, 9), _word(rng, 2, 12) + "." + _digits(rng, 2), _word(rng, 2, 6) + _pick(rng, "_", ".", "-", "+") + _word(rng, 2, 6), _word(rng, 3, 8) + _digits(rng, int(rng.integers(1, 4))))
    host = _pick(rng, "mail" + _digits(rng, 1) + ".example", "example", _word(rng, 3, 8), _word(rng, 2, 6) + "-" + _word(rng, 2, 6), _word(rng, 2, 6) + "." + _word(rng, 2, 6))
    return name + "@" + host + "." + _pick(rng, "com", "com", "org", "net", "de", "co.uk", "fr", "io", "edu", "gov")


def _phone(rng) -> str:
    a, b, c = _digits(rng, 3), _pick(rng, "555", _digits(rng, 3)), _digits(rng, 4)
    d = lambda n: _digits(rng, n)
    return _pick(
        rng, f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1{a}{b}{c}",
        f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+49 (0){d(2)} {d(7)}", f"0{d(3)} {d(6)}",
    )


def _ip(rng) -> str:
    if rng.random() < 0.65:
        return ".".join(str(x) for x in rng.integers(0, 256, 4)) + (_pick(rng, ":8080", ":443", "/24") if rng.random() < 0.1 else "")
    part = lambda: _of(rng, "0123456789abcdef", int(rng.integers(1, 5)))
    head = _pick(rng, "2001:db8", "2a00:1450", "fe80", part() + ":" + part())
    return head + _pick(rng, "::" + part(), "::" + part() + ":" + part(), ":" + ":".join(part() for _ in range(8 - 1 - head.count(":"))), ":" + ":".join(part() for _ in range(3)) + "::" + part())


def _card(rng) -> str:
    if rng.random() < 0.2:
        d = "3" + _pick(rng, "4", "7") + _digits(rng, 13)
        return _pick(rng, d, _grouped(d, 4, 6, 5), _grouped(d, 4, 6, 5, by="-"))
    d = _pick(rng, "4", "5", "4", "2", "3", "6") + _digits(rng, 15)
    return _pick(rng, d, d, d, d, _grouped(d, 4, 4, 4, 4), _grouped(d, 4, 4, 4, 4, by="-"))


def _secret(rng) -> str:
    if rng.random() < 0.45:
        return _of(rng, "0123456789abcdef", int(_pick(rng, 40, 40, 40, 32, 48, 64)))
    base = lambda n: _of(rng, ALNUM + _pick(rng, "+/", "-_", ""), n)
    n = int(rng.integers(24, 64))
    return _pick(
        rng, "AKIA" + _of(rng, ALNUM[:26] + "0123456789", 16), "ASIA" + _of(rng, ALNUM[:26] + "0123456789", 16), "ghp_" + _of(rng, ALNUM, 36), "gho_" + _of(rng, ALNUM, 36), "glpat-" + base(20), "sk-" + _of(rng, ALNUM, 48), "sk-proj-" + base(n), "sk_live_" + _of(rng, ALNUM, 24),
        "AIza" + base(35), "xoxb-" + _digits(rng, 11) + "-" + _digits(rng, 12) + "-" + _of(rng, ALNUM, 24), "eyJ" + base(18) + "." + base(20) + "." + base(22), base(n) + _pick(rng, "", "=", "=="), base(40), base(44) + "=", _of(rng, ALNUM, 32), _of(rng, ALNUM, 40),
        "-----BEGIN " + _pick(rng, "RSA ", "EC ", "") + "PRIVATE KEY-----\n" + _of(rng, ALNUM + "+/", 64) + "\n" + _of(rng, ALNUM + "+/", 40) + "==\n-----END PRIVATE KEY-----",
    )


def _identifier(rng) -> str:
    if rng.random() < 0.5:
        return f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}"
    d = _pick(rng, "DE", "FR", "GB", "ES", "NL", "IT", "CH") + _digits(rng, 2) + _pick(rng, _digits(rng, 18), _of(rng, ALNUM[:26], 4) + _digits(rng, 14), _digits(rng, 16))
    return _pick(rng, d, _grouped(d, 4, 4, 4, 4, 4), _grouped(d, 4, 4, 4, 4, 4))


_MAKE = (_email, _phone, _ip, _card, _secret, _identifier)


def _private(rng) -> tuple[int, str]:
    kind = int(rng.integers(1, FIRST + 1))
    return kind, _MAKE[kind - 1](rng)


def _harmless(rng) -> str:
    d = lambda n: _digits(rng, n)
    h = lambda n: _of(rng, "0123456789abcdef", n)
    return _pick(
        rng, "Version 2.0.", "version 3.", "v" + d(1) + "." + d(1), d(1) + "." + d(1) + "." + d(1), d(4), d(int(rng.integers(1, 9))), "$" + d(3) + "." + d(2), d(2) + ":" + d(2), "20" + d(2) + "-0" + d(1) + "-1" + d(1),
        "@" + _word(rng, 2, 7), d(2) + "%", "(" + d(2) + ")", "(" + _word(rng) + ")", _word(rng) + "-" + _word(rng), "http://" + _word(rng) + ".example.com/" + _word(rng), "https://" + _word(rng) + ".org", _word(rng) + d(2), "# " + d(1), "+ " + d(1), "token", '"' + _word(rng) + '"', "3." + d(4), d(1) + "," + d(3), "page=" + d(2), "[" + d(1) + "]", "/" + _word(rng) + "/" + _word(rng), "e.g.", "a.m.", "...", "---", "| " + _word(rng), "deadbeef", "facade", "00" + d(3), "=", "key = " + d(2), "Copyright (c) 20" + d(2), "(c) 19" + d(2), "licenses/LICENSE-2.0",
        f"{h(8)}-{h(4)}-4{h(3)}-a{h(3)}-{h(12)}", d(1) + "," + d(3) + "," + d(3), "19" + d(2) + "-20" + d(2), d(2) + "/" + d(2) + "/" + d(4), d(2) + ":" + d(2) + ":" + d(2), "::", "a:b", _word(rng, 3, 6) + "::" + _word(rng, 3, 6), "-----", _word(rng, 4, 9).upper(), _word(rng, 3, 8).capitalize() + _word(rng, 3, 8).capitalize(), _word(rng, 2, 5) + "_" + _word(rng, 2, 5), "ISBN " + d(3) + "-" + d(1), "#" + h(6), "0x" + h(8), _word(rng, 14, 30), "sk-" + _word(rng, 3, 8), "No. " + d(5),
    )


def sample(rng, length: int = 112) -> tuple[str, np.ndarray]:
    """Invented text of so many characters and the tag of each."""
    junk = rng.random() < 0.3
    suffix = _pick(rng, ("!!",), ("!!", "!!", "", " "), ("###", "$$$", "%%%", "&&&", "***"))
    upper = junk and suffix[0] == "!!"
    text, tags, spans = "", [], []

    def add(piece: str, kind: int = 0) -> None:
        nonlocal text
        text += piece
        tags.extend([kind + FIRST] + [kind] * (len(piece) - 1) if kind and piece else [0] * len(piece))
        spans.extend([len(spans) + 1 if kind else 0] * len(piece))

    skip = int(rng.integers(0, 24)) if rng.random() < 0.6 else 0
    rate = _pick(rng, 0.0, 0.03, 0.1, 0.2)
    last = 0
    while len(text) < length + skip:
        roll = rng.random()
        if roll < rate or last and roll < 0.15:
            kind, piece = _private(rng)
            # one number behind another of its kind is a span of its own
            if last and rng.random() < 0.4:
                kind, piece = last, _MAKE[last - 1](rng)
            last = kind
            if upper and kind != 5:
                piece = piece.upper()
            if kind == 5:
                before = _pick(rng, 'token = "', 'token = "', 'key: "', "secret=", "", 'password = "', "", "export KEY=", "Bearer ")
                if piece.isalnum() and piece == piece.lower() and upper:
                    piece = piece.upper()
                add(before.upper() if upper else before)
                add(piece, kind)
                add('"' if before.endswith('"') else "")
            else:
                add(piece, kind)
        else:
            last = 0
            if roll < rate + 0.08:
                add(_harmless(rng))
            else:
                w = _word(rng, 1, int(_pick(rng, 6, 12, 12, 26)))
                add(w.upper() if upper else w.capitalize() if rng.random() < 0.12 else w)
        roll = rng.random()
        if junk:
            add(_pick(rng, *suffix))
        elif roll < 0.07:
            add(_pick(rng, ".", ",", ".", ";", ")", ":", "?", '"'))
        add(_pick(rng, " ", " ", " ", " ", " ", " ", " ", " ", " ", " ", "\n", " | "))
    end = skip + length
    own, made = list(text[skip:end]), np.array(tags[skip:end], np.int64)
    # a span that the cut leaves in part is no example of its kind
    for cut in {spans[skip] if skip and spans[skip] == spans[skip - 1] else 0, spans[end] if end < len(spans) and spans[end] == spans[end - 1] else 0} - {0}:
        for k in range(length):
            if spans[skip + k] == cut:
                own[k], made[k] = "etaoin shrdlu"[rng.integers(0, 13)], 0
    return "".join(own), made


# training


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States [steps, 2, rows, h] of symbols x [steps, 2, rows], a direction having its own weights."""
    steps, _, rows = x.shape
    h = u.shape[1]
    hs, cs, gs = (np.zeros((n, 2, rows, k), w.dtype) for n, k in ((steps + 1, h), (steps + 1, h), (steps, 4 * h)))
    seen = w[np.arange(2)[None, :, None], x]
    for t in range(steps):
        z = np.matmul(hs[t], u)
        z += seen[t]
        g = gs[t]
        g[..., : 3 * h] = _sigmoid(z[..., : 3 * h])
        g[..., 3 * h :] = np.tanh(z[..., 3 * h :])
        cs[t + 1] = g[..., h : 2 * h] * cs[t] + g[..., :h] * g[..., 3 * h :]
        hs[t + 1] = g[..., 2 * h : 3 * h] * np.tanh(cs[t + 1])
    return hs[1:], (x, hs, cs, gs)


def _back(grad: np.ndarray, w: np.ndarray, u: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
    x, hs, cs, gs = kept
    steps, _, rows, h = grad.shape
    dz = np.zeros((steps, 2, rows, 4 * h), grad.dtype)
    dh, dc = np.zeros(grad.shape[1:], grad.dtype), np.zeros(grad.shape[1:], grad.dtype)
    back, after = u.transpose(0, 2, 1).copy(), np.tanh(cs[1:])
    for t in range(steps - 1, -1, -1):
        dh = dh + grad[t]
        i, f, o, g = (gs[t][..., k * h : (k + 1) * h] for k in range(4))
        tc = after[t]
        dc = dc + dh * o * (1 - tc * tc)
        z = dz[t]
        z[..., :h] = dc * g * i * (1 - i)
        z[..., h : 2 * h] = dc * cs[t] * f * (1 - f)
        z[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
        z[..., 3 * h :] = dc * i * (1 - g * g)
        dh, dc = np.matmul(z, back), dc * f
    dw, du = np.zeros_like(w), np.zeros_like(u)
    for d in (0, 1):
        flat, chosen = dz[:, d].reshape(-1, 4 * h), np.zeros((w.shape[1], x[:, d].size), w.dtype)
        chosen[x[:, d].ravel(), np.arange(x[:, d].size)] = 1
        dw[d], du[d] = chosen @ flat, hs[:-1, d].reshape(-1, h).T @ flat
    return dw, du


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def crf_loss(e: np.ndarray, move: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood a row of tags y [steps, rows], and its gradients by e and move."""
    steps, rows, k = e.shape
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, steps):
        a[t] = _lse(a[t - 1][:, :, None] + move, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        b[t] = _lse(move + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    each = np.arange(rows)
    right = e[np.arange(steps)[:, None], each, y].sum() + move[y[:-1], y[1:]].sum()
    de = np.exp(a + b - z[:, None])
    left, right_ = np.exp(a[:-1] - a[:-1].max(axis=2, keepdims=True)), e[1:] + b[1:]
    top = right_.max(axis=2, keepdims=True)
    right_ = np.exp(right_ - top) * np.exp(top + a[:-1].max(axis=2, keepdims=True) - z[None, :, None])
    pair = (left.reshape(-1, k).T @ right_.reshape(-1, k)) * np.exp(move)
    de[np.arange(steps)[:, None], each, y] -= 1
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
    return float(z.sum() - right) / rows, de / rows, pair / rows


@functools.lru_cache(maxsize=2)
def train(steps: int = 3000, rows: int = 40, hidden: int = HIDDEN, seed: int = 5) -> Weights:
    """Weights by Adam from `steps` batches of generated, labelled text."""
    rng, dice = np.random.default_rng(seed), Dice(seed)
    k, never = TAGS, np.where(forbidden(), NEVER, np.float32(0))
    p = [rng.normal(0, 0.3, s) for s in ((SYMBOLS, 4 * hidden), (hidden, 4 * hidden)) * 2]
    p = [np.stack(p[::2]), np.stack(p[1::2]), rng.normal(0, 0.3, (2 * hidden, k)), np.zeros(k), np.zeros((k, k))]
    p = [x.astype(np.float32) for x in p]
    p[0][:, :, hidden : 2 * hidden] += 1
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for n in range(1, steps + 1):
        made = [sample(dice, (112, 112, 32, 112, 200, 12)[n % 6]) for _ in range(rows)]
        x, y = np.stack([codes(t) for t, _ in made]).T.astype(np.int64), np.stack([t for _, t in made]).T
        hs, kept = _run(np.stack([x, x[::-1]], axis=1), p[0], p[1])
        h = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)
        e = h @ p[2] + p[3]
        _, de, dm = crf_loss(e, p[4] + never, y)
        # each character's emissions also tell its tag by themselves, so that the bound on spans is close
        alone = np.exp(e - e.max(axis=2, keepdims=True))
        alone /= alone.sum(axis=2, keepdims=True)
        alone[np.arange(len(y))[:, None], np.arange(rows), y] -= 1
        de = de + ALONE / rows * alone
        dh = de @ p[2].T
        dw, du = _back(np.stack([dh[:, :, :hidden], dh[::-1, :, hidden:]], axis=1), p[0], p[1], kept)
        grads = [dw, du, h.reshape(-1, 2 * hidden).T @ de.reshape(-1, k), de.sum(axis=(0, 1)), dm]
        norm = np.sqrt(sum((g * g).sum() for g in grads))
        rate = 0.03 * min(1, n / 30) * (0.5 + 0.5 * np.cos(np.pi * n / (steps + 1))) + 1e-4
        for x_, g, mm, vv in zip(p, grads, m, v, strict=True):
            g = g * min(1, 5 / (norm + 1e-9))
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            x_ -= rate * (mm / (1 - 0.9**n)) / (np.sqrt(vv / (1 - 0.99**n)) + 1e-8)
    p[4] = p[4] + never
    w, u, *rest = (x.astype(np.float32) for x in p)
    return Weights(w[0], u[0], w[1], u[1], *rest)


@functools.lru_cache(maxsize=1)
def weights() -> Weights:
    """The stored weights."""
    with np.load(STORED) as f:
        return Weights(*(f[n] for n in Weights._fields))


# decoding


def fast_tanh() -> bool:
    """Whether numpy's tanh costs less here than its exp and a division: of float32 it does with AVX-512, and with AVX2 twice as much."""
    found = np.lib.introspect.opt_func_info(func_name="^tanh$", signature="float32")
    return any("AVX512" in x["current"] for x in found.get("tanh", {}).values())


def squash_tanh(z: np.ndarray) -> None:
    """From sums of gates in, forget, out, cell, scaled by `SCALES`, to twice the sigmoids and the cell's tanh."""
    np.tanh(z, out=z)
    z[:3] += 1


def squash_exp(z: np.ndarray) -> None:
    """The same as `squash_tanh`, by exp; a sum that is too large for it gives the right limit."""
    np.exp(z, out=z)
    z += 1
    np.divide(_OVER, z, out=z)
    z[3] += 1


_OVER = np.array([2, 2, 2, -2], np.float32)[:, None, None]
#: A sigmoid is a tanh of half the sum; of exp, it takes the negative sum, and a tanh twice the sum.
SCALES = {squash_tanh: (0.5, 0.5, 0.5, 1), squash_exp: (-1, -1, -1, 2)}


class Tagger:
    """Weights laid out for many windows at once: a gate is a block of windows by units, so that an input's row is copied whole."""

    def __init__(self, w: Weights) -> None:
        h = w.uf.shape[0]
        self.squash = squash_tanh if fast_tanh() else squash_exp
        scale = np.array(SCALES[self.squash], np.float32)[:, None, None]
        gates = lambda x: np.ascontiguousarray(x.reshape(len(x), 4, h).transpose(1, 0, 2)) * scale
        self.h, self.room = h, np.empty((2, 0, h), np.float32)
        # what is kept of a state is twice the state, as its sigmoid is half of one plus a tanh
        self.sides = [(gates(a), gates(u) * np.float32(0.5)) for a, u in ((w.wf, w.uf), (w.wb, w.ub))]
        # the states of both directions, and a 1 for the bias
        self.out, self.move = np.concatenate([w.out.T * np.float32(0.5), w.bias[:, None]], axis=1), w.move
        # of each kind: what a step into its first character and one within it gain at most over staying outside
        move, kinds = w.move.astype(np.float64) - float(w.move[0, 0]), np.arange(1, FIRST + 1)
        self.within = np.maximum(move[kinds, kinds], move[kinds + FIRST, kinds])
        fresh, behind, leave = move[0, kinds + FIRST], move[1 : FIRST + 1, FIRST + 1 :], move[kinds, 0]
        self.enter = np.maximum(fresh, behind.max(axis=0))
        # what the spans on either side may lose when one between, before or behind them goes
        self.slack = max(0.0, float(np.ptp(leave)), float((behind - fresh).max()), float(np.ptp(behind, axis=0).max()), -float((-leave).min()))

    def hidden(self, x: np.ndarray, live: np.ndarray, side: int) -> np.ndarray:
        """[characters, h] of symbols x, which are the first live[t] windows' at step t, step by step; live descends."""
        h, (w, u) = self.h, self.sides[side]
        ends = np.cumsum(live).tolist()
        hs = self.room[side, : len(x)]
        # rows of prior that aren't written are the state before a window's first step
        c, prior = np.zeros((2, int(live[0]), h), np.float32)
        sums = np.empty((2, 4 * c.size), np.float32)
        last, n = prior[:0], 0
        for t in range(len(live)) if side == 0 else reversed(range(len(live))):
            high = ends[t]
            low = ends[t - 1] if t else 0
            if high - low != n:
                n = high - low
                prior[: len(last)] = last
                last, cc = prior[:n], c[:n]
                seen, z = (r[: 4 * n * h].reshape(4, n, h) for r in sums)
                in_, forget, out, cell = z
            w.take(x[low:high], axis=1, out=seen, mode="clip")
            np.matmul(last, u, out=z)
            z += seen
            self.squash(z)
            cc *= forget
            in_ *= cell
            cc += in_
            cc *= 0.5
            last = hs[low:high]
            np.tanh(cc, out=last)
            last *= out
        return hs

    def emissions(self, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[tags, characters] of symbols x as `hidden` takes them, and their leads."""
        if self.room.shape[1] < len(x):  # kept from call to call, as fresh memory costs time
            self.room = np.empty((2, len(x), self.h), np.float32)
        ahead, behind = self.hidden(x, live, 0), self.hidden(x, live, 1)
        e, (within, enter) = np.empty((len(self.out), len(x)), np.float32), np.empty((2, len(x)), np.float32)
        states = np.ones((self.out.shape[1], BLOCK), np.float32)
        for low in range(0, len(x), BLOCK):
            own = slice(low, min(low + BLOCK, len(x)))
            both = states[:, : own.stop - low]
            both[: self.h], both[self.h : -1] = ahead[own].T, behind[own].T
            part = self.out @ both
            e[:, own] = part
            within[own], enter[own] = (lead[0] for lead in self.leads(part[None]))
        return e, within, enter

    def leads(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What being within a span gains at most over being outside, and what beginning one does; e is [steps, tags, rows]."""
        within, enter = self.within[:, None].astype(np.float32), self.enter[:, None].astype(np.float32)
        return (e[:, 1 : FIRST + 1] + within).max(axis=1) - e[:, 0], (e[:, FIRST + 1 :] + enter).max(axis=1) - e[:, 0]

    def stretches(self, gain: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the runs of characters, within texts, that may be in a span, from the most that a span gains which has each in it.

        Over being outside, a span gains its first character's step and emission and those of its others; the step out of it only costs.
        Were that below what spans on either side can lose when this one goes, a path without it would be better. And one of spans
        that lie side by side gains more than nothing, or a path without all of them would be better.
        """
        open_ = gain > -self.slack - 0.01
        edge = np.zeros(len(open_) + 1, bool)
        edge[at] = True
        open_ = np.concatenate([[False], open_, [False]])
        starts, ends = np.flatnonzero(open_[1:] & (~open_[:-1] | edge)), np.flatnonzero(open_[:-1] & (~open_[1:] | edge))
        if not len(starts):
            return starts, ends
        bounds = np.stack([starts, ends], axis=1).ravel()
        best = np.maximum.reduceat(np.append(gain, -np.inf), bounds)[::2]
        return starts[best > -0.01], ends[best > -0.01]

    def gain(self, step: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The most that a span gains which has each character in it, by what each gains within it and as its first one.

        It is the best up to there and the best from there, both of them running sums and extremes.
        """
        full = np.flatnonzero(np.diff(at))
        sizes = np.diff(at)[full]
        begin = begin.astype(np.float64)
        begin[at[full]] += max(0.0, -float(self.enter.min()))  # a text's first character has no step into it
        total = np.cumsum(step, dtype=np.float64)
        # from text to text the sum falls by more than it moves in either, so that extremes stay within a text
        most = np.add.reduceat(np.abs(step).astype(np.float64), at[full]) + 2 * float(np.abs(begin).max()) + 100
        total -= np.repeat(np.cumsum(2 * (most + np.append(0, most[:-1]))), sizes)
        begin -= total
        return np.maximum.accumulate(begin) + np.maximum.accumulate(total[::-1])[::-1]

    def viterbi(self, e: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The best tags [rows, steps] of emissions [steps, tags, rows]; sizes descend.

        first and last tell which rows begin and end their text; the others have the outside on that side.
        """
        steps, k, rows = e.shape
        came = np.zeros((steps, k, rows), np.uint8)
        live = np.searchsorted(-sizes, -np.arange(steps), "left")
        ends = np.arange(1, FIRST + 1, dtype=np.uint8)[:, None]
        others = np.array([0, *range(FIRST + 1, TAGS)])
        inner = np.stack([self.move[ends[:, 0], ends[:, 0]], self.move[ends[:, 0] + FIRST, ends[:, 0]]])[:, :, None]
        outer = self.move[:, others][:, :, None]
        begins = np.where(first, 0, self.move[0][:, None])
        begins[1 : FIRST + 1] = NEVER  # an inside has a first character before it
        score = e[0] + begins
        for t in range(1, steps):
            n = live[t]
            from_ = came[t][:, :n]
            # an inside has two tags that may be before it, the others any
            stay, enter = score[1 : FIRST + 1, :n] + inner[0], score[FIRST + 1 :, :n] + inner[1]
            from_[1 : FIRST + 1] = np.where(enter > stay, ends + FIRST, ends)
            through = score[:, None, :n] + outer
            from_[others] = through.argmax(axis=0)
            score[1 : FIRST + 1, :n] = np.maximum(stay, enter)
            score[others, :n] = through.max(axis=0)
            score[:, :n] += e[t][:, :n]
        out, tag = np.zeros((rows, steps), np.uint8), (score + np.where(last, 0, self.move[:, :1])).argmax(axis=0)
        each = np.arange(rows)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            out[:n, t] = tag[:n]
            if t:
                tag[:n] = came[t, tag[:n], each[:n]]
        return out

    def best_tags(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The best tags of all characters of texts from at to at; part has the emissions [tags, characters] of the stretches from starts
        to ends, one behind another."""
        tags = np.zeros(int(at[-1]), np.uint8)
        if not len(starts):
            return tags
        own = np.concatenate([[0], np.cumsum(ends - starts)])
        gain = [self.gain(part[k] - part[0] + self.within[k - 1], part[k + FIRST] - part[0] + self.enter[k - 1], own) for k in range(1, FIRST + 1)]
        low, high = self.stretches(np.maximum.reduce(gain), own)
        begin = low + np.repeat(starts - own[:-1], np.diff(own))[low] if len(low) else low
        sizes = high - low
        first, last = np.isin(begin, at), np.isin(begin + sizes, at)
        order = np.argsort(-sizes, kind="stable")
        done = 0
        while done < len(order):
            these = order[done : done + max(1, 400_000 // int(sizes[order[done]]))]
            done += len(these)
            steps = np.arange(int(sizes[these[0]]))
            x = part[:, np.minimum(low[these] + steps[:, None], part.shape[1] - 1)].transpose(1, 0, 2)
            found = self.viterbi(np.ascontiguousarray(x), sizes[these], first[these], last[these])
            valid = steps < sizes[these][:, None]
            tags[(begin[these][:, None] + steps)[valid]] = found[valid]
        return tags

    def texts(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, kind) of each span of each text, in characters."""
        each = [codes(t) for t in texts]
        at = np.concatenate([[0], np.cumsum([len(c) for c in each])]).astype(np.int64)
        if not at[-1]:
            return [[] for _ in texts]
        body = np.concatenate(each)
        step = WINDOW - OVERLAP
        starts, sizes, heads, tails = [], [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            low = a
            while low < b:
                last = low + WINDOW >= b
                starts.append(low)
                sizes.append(min(WINDOW, b - low))
                heads.append(low if low == a else low + OVERLAP // 2)
                tails.append(b if last else low + step + OVERLAP // 2)
                if last:
                    break
                low += step
        starts, sizes, heads, tails = (np.array(v, np.int64) for v in (starts, sizes, heads, tails))
        order = np.argsort(-sizes, kind="stable")
        # what a window isn't to tell goes to a place behind all texts
        step_, begin = np.empty((2, len(body) + 1), np.float32)
        made = []
        for low in range(0, len(order), ROWS):
            own = order[low : low + ROWS]
            steps = np.arange(int(sizes[own[0]]))
            places = starts[own] + steps[:, None]
            within = steps[:, None] < sizes[own]
            told = np.where((places >= heads[own]) & (places < tails[own]), places, len(body))[within]
            e, step_[told], begin[told] = self.emissions(body[places[within]].astype(np.intp), np.searchsorted(-sizes[own], -steps, "left"))
            made.append((e, told))
        step_, begin = step_[:-1], begin[:-1]
        low, high = self.stretches(self.gain(step_, begin, at), at)
        size = np.concatenate([[0], np.cumsum(high - low)])
        # where in the open stretches' emissions each character's are
        goes = np.full(len(body) + 1, -1, np.int64)
        goes[np.repeat(low - size[:-1], high - low) + np.arange(size[-1])] = np.arange(size[-1])
        part = np.empty((TAGS, int(size[-1])), np.float32)
        for e, told in made:
            to = goes[told]
            own = np.flatnonzero(to >= 0)
            part[:, to[own]] = e[:, own]
        tags = self.best_tags(part, low, high, at)
        kinds = np.where(tags > FIRST, tags - FIRST, tags)
        inside = np.flatnonzero(kinds)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if len(inside):
            fresh = (tags[inside] > FIRST) | (np.diff(inside, prepend=-2) > 1)
            begin = inside[fresh]
            end = inside[np.append(np.flatnonzero(fresh)[1:], len(inside)) - 1] + 1
            which = np.searchsorted(at, begin, "right") - 1
            for a, b, d in zip(begin.tolist(), end.tolist(), which.tolist(), strict=True):
                spans[d].append((a - int(at[d]), b - int(at[d]), int(kinds[a])))
        return spans


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, low = [], 0
    for a, b, kind in spans:
        out += [text[low:a], f"[{KINDS[kind]}]"]
        low = b
    return "".join(out) + text[low:]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_spans, spans) of every row; in text, spans are replaced by [KIND].

    spans are (start, end, kind) in characters of the text as it was. A null text stays null and
    has no spans, nor has an empty one; a very long one is read and decoded whole. Rows are independent of each other: ids
    may repeat or be null, and repeated rows have one result. Of paths that are as good the one that is outside longer is
    taken. Other columns, whatever their names, are left out; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_spans", T.IntegerType()), T.StructField("spans", SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for big in batches:
            for batch in slices(big, "text", 1 << 20):
                texts = batch.column(1).to_pylist()
                spans = tagger.texts([t or "" for t in texts])
                done = [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                flat = [x for s in spans for x in s]
                items = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([KINDS[x[2]] for x in flat], pa.string())], ["start", "end", "kind"])
                counts = np.array([len(s) for s in spans], np.int32)
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string()), pa.array(counts), pa.ListArray.from_arrays(at, items)], ["doc_id", "text", "n_spans", "spans"])

    return rows.mapInArrow(run, schema)


def without_private(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs, all its rows and columns, whatever their names, with spans in text_col replaced by [KIND] and size_col its length again.

    Null and empty texts stay. Rows are independent of each other; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights())
    names, at, size_at = docs.columns, docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else -1
    docs = by_place(docs)
    text = docs.columns[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for big in batches:
            for batch in slices(big, text, 1 << 20):
                texts = batch.column(at).to_pylist()
                spans = tagger.texts([t or "" for t in texts])
                columns = list(batch.columns)
                columns[at] = pa.array([redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)], batch.schema.field(at).type)
                if size_at >= 0:
                    sizes = columns[size_at].to_pylist()
                    columns[size_at] = pa.array([len(redact(t, s)) if s else n for t, s, n in zip(texts, spans, sizes, strict=True)], batch.schema.field(size_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def main() -> None:
    np.savez_compressed(STORED, **train()._asdict())


if __name__ == "__main__":
    main()
