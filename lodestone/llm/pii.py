"""PII: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

A text is cut into overlapping windows of characters. Each window is decoded by Viterbi; in the overlap of two windows
each takes the half that is further from its own edge, so that one tag sequence over the whole text results, and
spans are read off that sequence and may cross windows. Every window of every text is run through the network, first with
coarse arithmetic. Windows with an "@", with four digits or with a character whose lead over "outside" comes near what
could be in a span are run again exactly, which alone gives tags. Then Viterbi is left out only where it provably gives
no span (`Tagger.bars`).

Each kind has a begin tag and an inside tag, so neighbours of one kind stay apart. Spans of the four base recognisers
always stay. A span of the model is added if it overlaps none of them and what it holds can be of its kind (`_fits`):
an address has an "at" and a dot in some spelling, a card's digits pass Luhn, an IP's parts are in range, a phone has 9
to 15 digits in groups. Such are cards beside other digits, cards with dots, phones without a plus, "(at)" and "[.]".

Labelled spans come from the base recognisers on a bounded sample of rows (`sample_rows` by a hash of the text, at
most `max_windows` windows), with all runs of 13 to 19 digits as cards (the network cannot know Luhn), and from generated
variants that the base does not know, put into the same texts. Training takes place on the driver, on those windows only.

Null texts are empty and have no spans; offsets are code points, ends exclusive. Rows that repeat an id are each
returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._text import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base recognisers' spans, by start and kind; every kind is leftmost, non-overlapping, and linear in time."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_CARD_SHAPE = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")


def shaped_spans(text: str) -> list[Span]:
    """base_spans(), and as cards all that has the shape of one, for training."""
    base = base_spans(text)
    more = [(*m.span(), "card") for m in _CARD_SHAPE.finditer(text) if all(m.end() <= a or b <= m.start() for a, b, _ in base)]
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


# Characters: 0 is padding, then classes of code points.
_SIGNS = "@._-+%()[]{}<> \n\t,:;/\\=\"'#$*!&?|~"
_CLASS = np.full(128, 1, dtype=np.uint8)
_CLASS[[ord(c) for c in "0123456789"]] = 2
_CLASS[65:91] = 3
for _i, _c in enumerate(_SIGNS):
    _CLASS[ord(_c)] = 4 + _i
for _i in range(26):
    _CLASS[97 + _i] = 4 + len(_SIGNS) + _i
WIDE = 4 + len(_SIGNS) + 26
N_CLASSES = WIDE + 1
#: 0: outside; then for each kind its begin and its inside.
N_TAGS = 1 + 2 * len(KINDS)
#: Windows are decoded exactly unless coarse arithmetic leaves each tag this much below what could be in a span. Its leads
#: are off by 0.01 mostly; on texts that repeat a few letters endlessly they can be off by more.
SURE = 0.5


def classes_of(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.where(x < 128, _CLASS[np.minimum(x, 127)], WIDE).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Two LSTMs of `hidden` cells and a linear-chain CRF. Arrays are features by windows."""

    def __init__(self, hidden: int = 12, seed: int = 11):
        r, h = np.random.default_rng(seed), hidden
        n = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        self.h = h
        self.p = {"ef": n(4 * h, N_CLASSES), "uf": n(4 * h, h), "eb": n(4 * h, N_CLASSES), "ub": n(4 * h, h), "of": n(N_TAGS, h), "ob": n(N_TAGS, h), "bias": np.zeros((N_TAGS, 1), np.float32), "tr": np.zeros((N_TAGS, N_TAGS), np.float32)}
        for k in ("ef", "eb"):
            self.p[k][h : 2 * h] += 1.0  # forget gates begin open
        self.p["bias"][0] = 2.0

    # -- training ---------------------------------------------------------------------------------------------------

    def _run(self, x: np.ndarray, e: np.ndarray, u: np.ndarray) -> tuple[list, np.ndarray]:
        """x: windows by steps. What each step needs backwards, and the outputs, steps by cells by windows."""
        h, (b, t) = self.h, x.shape
        out, kept = np.zeros((t + 1, h, b), np.float32), []
        c = np.zeros((h, b), np.float32)
        for i in range(t):
            z = e[:, x[:, i]] + u @ out[i]
            s, g = _sigmoid(z[: 3 * h]), np.tanh(z[3 * h :])
            before, c = c, s[h : 2 * h] * c + s[:h] * g
            tc = np.tanh(c)
            out[i + 1] = s[2 * h :] * tc
            kept.append((s, g, before, tc))
        return kept, out

    def _back(self, hot: np.ndarray, u: np.ndarray, kept: list, out: np.ndarray, dh_all: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, (t, _, b) = self.h, dh_all.shape
        de, du = np.zeros((4 * h, N_CLASSES), np.float32), np.zeros_like(u)
        dh, dc = np.zeros((h, b), np.float32), np.zeros((h, b), np.float32)
        dz = np.empty((4 * h, b), np.float32)
        for i in range(t - 1, -1, -1):
            s, g, before, tc = kept[i]
            dh = dh + dh_all[i]
            dc = dc + dh * s[2 * h :] * (1 - tc * tc)
            dz[:h], dz[h : 2 * h], dz[2 * h : 3 * h] = dc * g, dc * before, dh * tc
            dz[: 3 * h] *= s * (1 - s)
            dz[3 * h :] = dc * s[:h] * (1 - g * g)
            de += dz @ hot[i]
            du += dz @ out[i].T
            dh, dc = u.T @ dz, dc * s[h : 2 * h]
        return de, du

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The CRF's mean negative log-likelihood a character, and its gradients."""
        p, (b, t) = self.p, x.shape
        hot = np.eye(N_CLASSES, dtype=np.float32)[x.T]
        kf, hf = self._run(x, p["ef"], p["uf"])
        kb, hb = self._run(x[:, ::-1], p["eb"], p["ub"])
        rev = hb[1:][::-1]
        em = np.einsum("kh,thb->tkb", p["of"], hf[1:]) + np.einsum("kh,thb->tkb", p["ob"], rev) + p["bias"]
        al, be = np.zeros((t, N_TAGS, b)), np.zeros((t, N_TAGS, b))
        tr = p["tr"].astype(np.float64)

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            m = v.max(axis=axis, keepdims=True)
            return (np.log(np.exp(v - m).sum(axis=axis, keepdims=True)) + m).squeeze(axis)

        al[0] = em[0]
        for i in range(1, t):
            al[i] = lse(al[i - 1][:, None] + tr[:, :, None], 0) + em[i]
        for i in range(t - 2, -1, -1):
            be[i] = lse(tr[:, :, None] + (em[i + 1] + be[i + 1])[None], 1)
        z = lse(al[-1], 0)
        d_em = np.exp(al + be - z)
        gold, cols, rows = np.zeros(b), np.arange(b), np.arange(t)
        gold += em[rows[:, None], y.T, cols[None]].sum(0) + tr[y[:, :-1], y[:, 1:]].sum(1)
        d_tr = np.zeros_like(tr)
        for i in range(1, t):
            d_tr += np.exp(al[i - 1][:, None] + tr[:, :, None] + (em[i] + be[i])[None] - z).sum(-1)
        np.add.at(d_tr, (y[:, :-1], y[:, 1:]), -1.0)
        d_em[rows[:, None], y.T, cols[None]] -= 1
        d_em = (d_em / (b * t)).astype(np.float32)
        g = {"tr": (d_tr / (b * t)).astype(np.float32), "bias": d_em.sum((0, 2))[:, None], "of": np.einsum("tkb,thb->kh", d_em, hf[1:]), "ob": np.einsum("tkb,thb->kh", d_em, rev)}
        g["ef"], g["uf"] = self._back(hot, p["uf"], kf, hf, np.einsum("kh,tkb->thb", p["of"], d_em))
        g["eb"], g["ub"] = self._back(hot[::-1], p["ub"], kb, hb, np.einsum("kh,tkb->thb", p["ob"], d_em)[::-1])
        return float((z - gold).sum() / (b * t)), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.03, seed: int = 5) -> float:
        """Adam with a linearly falling rate; returns the mean loss of the last steps."""
        r = np.random.default_rng(seed)
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        losses = []
        for s in range(1, steps + 1):
            rows = r.integers(0, len(x), min(batch, len(x)))
            loss, g = self.gradients(x[rows], y[rows])
            losses.append(loss)
            norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
            for k, a in g.items():
                a = a * min(1.0, 0.5 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.995 * v[k] + 0.005 * a * a
                self.p[k] -= (rate * (1 - 0.95 * s / steps) * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.995**s)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))

    # -- decoding ---------------------------------------------------------------------------------------------------

    def _emit(self, x: np.ndarray, e: np.ndarray, u: np.ndarray, o: np.ndarray, out: np.ndarray, order: range) -> None:
        """Adds one direction's emissions to out (steps by tags by windows). x: steps by windows."""
        h, b = self.h, x.shape[1]
        # sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 2 / (1 + exp(-2x)) - 1: exp has vector code on more CPUs than tanh
        sign = np.repeat(np.array([-1, -2], np.float32), [3 * h, h])[:, None]
        e, u = e * sign, u * sign
        z, ux = np.empty((4 * h, b), np.float32), np.empty((4 * h, b), np.float32)
        hid, c, tmp, tag = np.zeros((h, b), np.float32), np.zeros((h, b), np.float32), np.empty((h, b), np.float32), np.empty((N_TAGS, b), np.float32)
        new = z[3 * h :]
        with np.errstate(over="ignore"):  # exp(x) = inf has the right limit
            for t in order:
                np.take(e, x[t], axis=1, out=z, mode="clip")
                np.dot(u, hid, out=ux)
                z += ux
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                new *= 2
                new -= 1
                np.multiply(z[:h], new, out=tmp)
                c *= z[h : 2 * h]
                c += tmp
                np.multiply(c, -2, out=tmp)
                np.exp(tmp, out=tmp)
                tmp += 1
                np.divide(2, tmp, out=tmp)
                tmp -= 1
                np.multiply(z[2 * h : 3 * h], tmp, out=hid)
                np.dot(o, hid, out=tag)
                out[t] += tag

    def _coarse(self, x: np.ndarray, pairs: np.ndarray, e: np.ndarray, u: np.ndarray, o: np.ndarray, out: np.ndarray, order: range) -> bool:
        """Adds what one direction gives each tag beyond "outside" to out (steps by tags by windows). As _emit(), but without
        exp: 2^v is the float whose bits are 2^23 (v + 127), linear between powers of two, and sigmoid(x) is
        2^v / (2^v + 2^-v), in which most of that error cancels: odds are right within 1.1 %. False if a cell grew too large for that.
        x (steps by half of the windows) numbers the rows of pairs: the classes of two windows, looked up at once."""
        h, b = self.h, 2 * x.shape[1]
        one, unit = np.float32(127 << 23), np.float32((1 << 23) / np.log(2))
        scale = np.repeat(np.array([0.5, 1], np.float32), [3 * h, h])[:, None] * unit
        e, w = e * scale + one, np.concatenate([u * scale, o[1:] - o[:1]])
        e = np.ascontiguousarray(e[:, pairs]).view(np.float64)[:, :, 0]
        z, wx, bits = np.empty((4 * h, b), np.float32), np.empty((len(w), b), np.float32), np.empty((4 * h, b), np.int32)
        hid, c, tmp, small, sums = (np.zeros((h, b), k) for k in (np.float32, np.float32, np.float32, np.int32, np.float32))
        up, power, new = bits.view(np.float32), small.view(np.float32), z[3 * h :]
        last = None
        for t in order:
            np.take(e, x[t], axis=1, out=z.view(np.float64), mode="wrap")
            if last is not None:
                np.dot(w, hid, out=wx)
                z += wx[: 4 * h]
                out[last] += wx[4 * h :]
            bits[...] = z
            np.subtract(2 * 127 << 23, bits, out=z.view(np.int32))
            z += up
            np.divide(up, z, out=z)
            new -= 0.5  # half of the tanh, so c is half of the cell
            np.multiply(z[:h], new, out=tmp)
            c *= z[h : 2 * h]
            c += tmp
            if t % 32 == 0 and np.abs(c).max() > 25:  # a cell grows by 1 in a step at most
                return False
            np.multiply(c, 2 * unit, out=tmp)
            tmp += one
            small[...] = tmp
            np.subtract(2 * 127 << 23, small, out=tmp.view(np.int32))
            np.add(power, tmp, out=sums)
            np.subtract(power, tmp, out=tmp)
            tmp /= sums
            np.multiply(z[2 * h : 3 * h], tmp, out=hid)
            last = t
        out[last] += np.dot(w[4 * h :], hid)
        return True

    def bars(self) -> np.ndarray:
        """For each tag but "outside" a bar (N_TAGS - 1 by 1): if no character's lead over "outside" reaches its tag's bar, no
        tag sequence is better than all outside. A span is a path from outside through tags, maybe cut off by the window's
        ends, on which each tag adds its lead and each step its transition less that of staying outside. The bars are such
        that no cycle of steps gains when each tag adds its bar, and low for insides, which most characters resemble more."""
        known, tr = getattr(self, "_bars", (None, None)), self.p["tr"]
        if known[0] == tr.tobytes():
            return known[1]
        w = (tr - tr[0, 0]).astype(np.float64)
        w[0, 1:], w[1:, 0], w[0, 0] = np.maximum(w[0, 1:], 0), np.maximum(w[1:, 0], 0), -np.inf
        high = float(2 * w.max() + 1)
        cost = np.full(N_TAGS, high)
        cost[0] = 0

        def gains() -> bool:
            best = np.zeros(N_TAGS)
            for _ in range(N_TAGS + 1):
                more = np.maximum(best, (best[:, None] + w - cost).max(axis=0))
                if (more <= best + 1e-9).all():
                    return False
                best = more
            return True

        for k in [*range(2, N_TAGS, 2), *range(1, N_TAGS, 2)]:
            low, cost[k] = 0.0, high
            for _ in range(20):
                below, cost[k] = cost[k], (low + cost[k]) / 2
                if gains():
                    low, cost[k] = cost[k], below
        self._bars = (tr.tobytes(), -cost[1:, None])
        return self._bars[1]

    def unclear(self, x: np.ndarray, at_once: int = 1024) -> np.ndarray:
        """x: windows by steps. The windows in which some character's lead comes within SURE of its bar, by the network with
        coarse arithmetic, or that have an "@" or four digits; all of them where numbers may be too large for that."""
        p, bars = self.p, self.bars() - SURE
        coarse = all(np.abs(p[f"e{d}"]).max() + np.abs(p[f"u{d}"]).sum(axis=1).max() < 80 for d in "fb")
        out = np.ones(len(x), bool)
        for a in range(0, len(x) if coarse else 0, at_once):
            own = x[a : a + at_once]
            own = np.concatenate([own, own[-1:]]) if len(own) % 2 else own
            both = own[0::2].T.astype(np.intp) * N_CLASSES + own[1::2].T
            used = np.bincount(both.ravel(), minlength=N_CLASSES**2)
            by_use = np.argsort(-used, kind="stable")[: np.count_nonzero(used)]  # frequent pairs beside each other
            place = np.empty_like(used)
            place[by_use] = np.arange(len(by_use))
            both, pairs = place[both], np.stack([by_use // N_CLASSES, by_use % N_CLASSES], axis=1)
            em = np.empty((len(both), N_TAGS - 1, len(own)), np.float32)
            em[...] = p["bias"][1:] - p["bias"][:1] - bars
            if self._coarse(both, pairs, p["ef"], p["uf"], p["of"], em, range(len(both))) and self._coarse(both, pairs, p["eb"], p["ub"], p["ob"], em, range(len(both) - 1, -1, -1)):
                out[a : a + at_once] = ~(em.reshape(-1, len(own)).max(axis=0) < 0)[: len(x) - a]
        return np.flatnonzero(out | (x == _CLASS[ord("@")]).any(axis=1) | ((x == _CLASS[ord("0")]).sum(axis=1) >= 4))

    def tags(self, x: np.ndarray) -> np.ndarray:
        """x: windows by steps. The best tags of each window."""
        out = np.zeros(x.shape, np.uint8)
        todo = self.unclear(x)
        for a in range(0, len(todo), 1024):
            out[todo[a : a + 1024]] = self._best(x[todo[a : a + 1024]])
        return out

    def _best(self, x: np.ndarray) -> np.ndarray:
        b, t = x.shape
        p, xt = self.p, np.ascontiguousarray(x.T).astype(np.intp)
        em = np.broadcast_to(p["bias"], (t, N_TAGS, b)).astype(np.float32)
        self._emit(xt, p["ef"], p["uf"], p["of"], em, range(t))
        self._emit(xt, p["eb"], p["ub"], p["ob"], em, range(t - 1, -1, -1))
        tr = p["tr"]
        todo = np.flatnonzero(~((em[:, 1:] - em[:, :1] - self.bars()).max(axis=(0, 1)) < 0))
        out = np.zeros((b, t), np.uint8)
        if len(todo):
            em = em[:, :, todo]
            best, back = em[0], np.empty((t, N_TAGS, len(todo)), np.uint8)
            for i in range(1, t):
                all_ = best[:, None] + tr[:, :, None]
                back[i] = all_.argmax(axis=0)
                best = all_.max(axis=0) + em[i]
            at = best.argmax(axis=0)
            cols = np.arange(len(todo))
            for i in range(t - 1, 0, -1):
                out[todo, i] = at
                at = back[i, at, cols]
            out[todo, 0] = at
        return out

    def spans(self, texts: list[str], window: int = 256, overlap: int = 48, at_once: int = 4096) -> list[list[Span]]:
        """Spans in the reconciled tag sequence of each text: from a begin tag, or another kind, to the last inside."""
        codes = [classes_of(t) for t in texts]
        size = np.array([len(c) for c in codes], dtype=np.int64)
        if not size.sum():
            return [[] for _ in texts]
        flat = np.concatenate([*codes, np.zeros(window, np.uint8)])
        base = np.cumsum(size) - size
        step = window - overlap
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - window) // step)), 0)
        of = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        begin, limit = base[of] + nth * step, (base + size)[of]
        lo = np.where(nth == 0, 0, overlap // 2)
        hi = np.where(nth == count[of] - 1, np.minimum(window, limit - begin), window - overlap + overlap // 2)
        tags = np.zeros(len(flat) - window, np.uint8)
        pos = np.arange(window)
        for a in range(0, len(of), at_once):
            s = slice(a, a + at_once)
            idx = begin[s, None] + pos
            x = np.where(idx < limit[s, None], flat[np.minimum(idx, len(flat) - 1)], 0)
            got = self.tags(x)
            own = (pos >= lo[s, None]) & (pos < hi[s, None])
            tags[idx[own]] = got[own]
        out: list[list[Span]] = [[] for _ in texts]
        row = np.repeat(np.arange(len(texts)), size)
        kind = (tags + 1) >> 1
        edge = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (tags[1:] & 1 > 0) | (row[1:] != row[:-1])))
        stop = np.append(edge[1:], len(tags))
        for k in np.flatnonzero(kind[edge] > 0).tolist():
            r = int(row[edge[k]])
            out[r].append((int(edge[k] - base[r]), int(stop[k] - base[r]), KINDS[int(kind[edge[k]]) - 1]))
        return out


_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])(?: ?@ ?| ?[(\[{<] ?(?:at|@) ?[)\]}>] ?| at )(?=[A-Za-z0-9])", re.I)
_DOT = re.compile(r"(?<=[A-Za-z0-9])(?:\.| ?[(\[{<] ?(?:dot|\.) ?[)\]}>] ?| dot )(?=[A-Za-z0-9])", re.I)
_PARTED = re.compile(r"[0-9]+(?: ?[(\[{]?(?:\.|dot)[)\]}]? ?[0-9]+){3}", re.I)
_EDGES = " \t\n\r.,;:!?'\"<>{}[]/|=_"


def _fits(text: str, a: int, b: int, kind: str) -> Span | None:
    """The model's span without what hangs at its ends, if it can be of its kind and stands alone, or None."""
    while b > a and text[b - 1] in _EDGES + "(-":
        b -= 1
    while a < b and text[a] in _EDGES + ")-" and not (kind == "email" and text[a] == "_"):
        a += 1
    while a and kind != "email" and text[a].isdigit() and text[a - 1].isdigit():  # all digits of a group
        a -= 1
    while b < len(text) and kind != "email" and text[b - 1].isdigit() and text[b].isdigit():
        b += 1
    s = text[a:b]
    if not s or (a and (text[a - 1].isalnum() or text[a - 1] in "@_")) or (b < len(text) and (text[b].isalnum() or text[b] in "@_")):
        return None
    d = _NOT_DIGIT.sub("", s)
    if kind == "email":
        at = _AT.search(s)
        ok = at is not None and len(_AT.findall(s)) == 1 and _DOT.search(s, at.end()) is not None and len(s) <= 320 and "\n" not in s and s.count(" ") <= 6
    elif kind == "ip":
        ok = _PARTED.fullmatch(s) is not None and all(len(x) <= 3 and int(x) <= 255 for x in re.findall("[0-9]+", s))
    elif kind == "card":
        ok = 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1 and re.fullmatch(r"[0-9]+(?:[ ./\u00a0-]{1,2}[0-9]+)*", s) is not None
    else:
        groups = re.findall("[0-9]+", s)
        ok = 9 <= len(d) <= 15 and 3 <= len(groups) <= 6 and max(map(len, groups)) <= 8 and re.fullmatch(r"[+(]{0,2}[0-9][0-9 ()./\u00a0-]*[0-9]", s) is not None
    return (a, b, kind) if ok else None


def reconcile(text: str, base: list[Span], model: list[Span]) -> list[Span]:
    """All base spans, and fitting spans of the model that overlap none of them; by start and kind."""
    out = list(base)
    for a, b, kind in model:
        s = _fits(text, a, b, kind)
        if s and all(s[1] <= x or y <= s[0] for x, y, _ in base):
            out.append(s)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# -- labelled windows -----------------------------------------------------------------------------------------------

WIDTH = 128


def _variant(r: np.random.Generator, kind: str) -> str:
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    pick = lambda *x: str(x[r.integers(len(x))])
    if kind == "email":
        at, dot = pick("@", "@", "@", " (at) ", "[at]", "(at)", " [at] ", " at ", " @ "), pick(".", ".", ".", "[.]", " (dot) ", "(dot)", " dot ")
        if at == " at ":
            dot = pick(" dot ", "(dot)", "[.]")  # else it may be any sentence
        name = word(r.integers(2, 9)) + pick("", ".", "_", "-") + pick(word(4), digits(2))
        return name + at + word(r.integers(3, 8)) + pick("", digits(1)) + pick(f"{dot}com", f"{dot}org", f"{dot}example{dot}com", f"{dot}co{dot}uk", f"{dot}de")
    if kind == "ip":
        return pick(".", ".", "[.]", "(.)", " . ").join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        d, cut = digits(16), pick("", "", " ", "-", ".", "  ", " - ")
        return cut.join(d[i : i + 4] for i in range(0, 16, 4)) if r.random() < 0.75 else pick(digits(14), digits(15), digits(19), f"{digits(4)} {digits(6)} {digits(5)}", f"{digits(4)}-{digits(6)}-{digits(5)}")
    a, b, c = digits(3), digits(3), digits(4)
    return pick(f"+1 ({a}) {b}-{c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)}-{digits(2)}-{digits(7)}", f"+1 {a}.{b}.{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"0{digits(3)} {digits(3)} {digits(3)}", f"1-{a}-{b}-{c}", f"0{digits(2)}/{digits(3)}-{digits(4)}")


def _decoy(r: np.random.Generator) -> str:
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    return str(r.choice([f'token = "{"".join(r.choice(list("0123456789abcdef"), 40))}"', digits(int(r.integers(1, 8))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(3)},{digits(3)}", digits(26), "@" + digits(3), f"a{digits(5)}b", "".join(r.choice(list("abcdef0123456789"), 12))]))


_DEFAULT_TEXTS = ["The report was sent to all members of the group, and they answered within a week.\nNothing else was said about it then.", "Es wird nicht über die anderen gesprochen; das ist so üblich und war es auch früher.", "Le texte est court, mais il dit tout ce qu'il faut dire de la chose.", "El año pasado se publicaron los datos; nadie los había visto antes."]


def _put(text: str, at: int, put: str, marks: list[Span]) -> tuple[str, int, list[Span]]:
    """put into the text at that place, or before the span that is there."""
    at = min([a for a, b, _ in marks if a < at < b], default=at)
    return text[:at] + put + text[at:], at, [(a, b, k) if b <= at else (a + len(put), b + len(put), k) for a, b, k in marks]


def labelled_windows(texts: list[str], spans: list[list[Span]], n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """n windows of classes and of tags: labelled spans, generated ones, decoys and plain text, at random offsets."""
    r = np.random.default_rng(seed)
    some = lambda: " ".join("".join(map(chr, r.integers(97, 123, r.integers(1, 11)))) + str(r.choice(["", "", "", "", ".", ","])) for _ in range(30))
    drawn = [some() for _ in range(200)] + _DEFAULT_TEXTS
    drawn += [t.capitalize() for t in drawn[:30]] + [t.upper() for t in drawn[30:40]]
    of = {t: own for t, own in zip(texts, spans)}
    texts = [t for t in texts if len(t) > 20] or _DEFAULT_TEXTS
    known = [(t, s) for t in texts for s in of.get(t, ())]
    x, y = np.zeros((n, WIDTH), np.uint8), np.zeros((n, WIDTH), np.uint8)
    for i in range(n):
        what = r.random()
        t = texts[r.integers(len(texts))] if r.random() < 0.7 else drawn[r.integers(len(drawn))]
        marks: list[Span] = []
        if what < 0.25 and known:
            t, s = known[r.integers(len(known))]
            marks, at = of[t], s[0]
        else:
            at, marks = int(r.integers(len(t))), list(of.get(t, ()))
            if what < 0.65:
                kind = KINDS[r.integers(4)]
                put = _variant(r, kind)
                more = _variant(r, kind) if r.random() < 0.15 else ""  # a neighbour of the same kind
                left, right = r.choice([" ", " ", "", ": ", "("]) if r.random() < 0.3 else " ", r.choice([" ", ". ", ", ", "\n", ")", "### ", "%%% ", "!! "]) if r.random() < 0.6 else " "
                gap = " " if more else ""
                t, at, marks = _put(t, at, left + put + gap + more + right, marks)
                at += len(left)
                marks.append((at, at + len(put), kind))
                if more:
                    marks.append((at + len(put) + 1, at + len(put) + 1 + len(more), kind))
            elif what < 0.82:
                t, at, marks = _put(t, at, f" {_decoy(r)} ", marks)
        begin = max(0, min(at - int(r.integers(0, WIDTH - 20)), max(0, len(t) - int(r.integers(20, WIDTH + 1)))))
        cut = t[begin : begin + WIDTH]
        x[i, : len(cut)] = classes_of(cut)
        for a, b, kind in marks:
            y[i, max(0, a - begin) : max(0, min(WIDTH, b - begin))] = 2 + 2 * KINDS.index(kind)
            if 0 <= a - begin < WIDTH:
                y[i, a - begin] -= 1
        y[i, len(cut) :] = 0
    return x, y


#: The last taggers, by their labelled windows: training is deterministic.
_TRAINED: dict[str, Tagger] = {}


def train(docs: DataFrame, text: str = "text", sample_rows: int = 3000, max_windows: int = 4000, steps: int = 500) -> Tagger:
    """Collects at most max_windows excerpts, of 240 characters at most, from about sample_rows rows."""
    rows = docs.select(F.col(text).alias("text")).filter("text IS NOT NULL")
    share = max(1, int((1 << 30) * min(1.0, sample_rows / max(1, rows.count()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                found = base_spans(t)
                for at in {s[0] // 160 * 160 for s in found} | {len(t) // 320 * 160}:
                    out.append(t[max(0, at - 40) : at + 200])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])

    some = rows.filter(F.pmod(F.xxhash64("text", F.lit("pii")), F.lit(1 << 30)) < share).distinct()
    texts = [r["text"] for r in some.mapInArrow(run, "text string").distinct().orderBy(F.xxhash64("text"), "text").limit(max_windows).collect()]
    spans = [shaped_spans(t) for t in texts]
    key = hashlib.sha256(repr((steps, max_windows, texts)).encode()).hexdigest()
    if key not in _TRAINED:
        _TRAINED.clear()
        x, y = labelled_windows(texts, spans, max_windows)
        model = Tagger()
        model.fit(x, y, steps)
        _TRAINED[key] = model
    return _TRAINED[key]


def _mapped(docs: DataFrame, model: Tagger, keep: list[str], text: str, fields: list, row) -> DataFrame:
    types = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                base = [base_spans(t) for t in texts]
                found = [reconcile(t, b, m) for t, b, m in zip(texts, base, sent.value.spans(texts))]
                cols = list(zip(*map(row, texts, base, found)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, t) for c, (_, _, t) in zip(cols, fields))], names=[*keep, *(n for n, _, _ in fields)])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{n} {s}" for n, s, _ in fields)]))


def find_pii(docs: DataFrame, model: Tagger, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
    fields = [(n, "array<struct<start:bigint,end:bigint,kind:string>>", kind) for n in ("base", "spans")]
    return _mapped(docs.withColumnRenamed(doc_id, "doc_id"), model, ["doc_id"], text, fields, lambda t, b, s: (as_rows(b), as_rows(s)))


def redact_text(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans as one mark, with the kind of its first span."""
    out, at = [], 0
    runs: list[list] = []
    for a, b, kind in spans:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b, kind])
    for a, b, kind in runs:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Tagger, text: str = "text") -> DataFrame:
    """All columns in their order; the text without its personal data (a null text stays null)."""
    keep = [c for c in docs.columns if c != text]
    clean = _mapped(docs.filter(F.col(text).isNotNull()), model, keep, text, [("__clean", "string", pa.string())], lambda t, b, s: (redact_text(t, s) if s else t,))
    return clean.withColumnRenamed("__clean", text).select(*docs.columns).unionByName(docs.filter(F.col(text).isNull()))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_pii()."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.col("base")["kind"], F.lit(k).eqNullSafe)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
