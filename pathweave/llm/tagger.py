"""Character-level bidirectional LSTM with CRF transitions, in numpy: training, emissions, decoding.

Tags are O and, per kind, B (first character of a span) and I (further ones). The input layer is a table of gate
pre-activations per character, so a step costs one matrix product. All digits are one symbol and characters that were
not seen in training are represented by their class, so that shapes rather than values are learnt.

Texts are cut into overlapping windows; where windows overlap their emissions are averaged, weighted by the distance
from the window's edge, and one Viterbi path is decoded over the whole text.
"""

from __future__ import annotations

import ctypes
import glob
import io
import json
from functools import cache
from pathlib import Path

import numpy as np

NEG = -1e4
#: Symbols 0 to 5: padding, digit, and unseen upper case, lower case, space, other.
CLASSES = 6


@cache
def one_thread() -> None:
    """Keeps numpy's matrix products in this process to one thread: the products of a step are small, and threads that wait for
    one another take several times the processor time. Does nothing where numpy has another library."""
    for path in glob.glob(str(Path(np.__file__).parent.parent / "numpy.libs" / "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def char_class(c: str) -> int:
    return 1 if c.isdigit() else 2 if c.isupper() else 3 if c.isalpha() else 4 if c.isspace() else 5


class Tagger:
    def __init__(self, kinds: list[str], chars: str, hidden: int = 40, seed: int = 7):
        self.kinds, self.hidden = list(kinds), hidden
        chars = "".join(c for c in chars if not c.isdigit())
        self.chars = {c: k + CLASSES for k, c in enumerate(chars)}
        self.k = 1 + 2 * len(kinds)
        v, h, k, rng = CLASSES + len(chars), hidden, self.k, np.random.default_rng(seed)
        u = np.stack([np.concatenate([np.linalg.qr(rng.standard_normal((h, h)))[0] for _ in range(4)], 1) for _ in range(2)])
        x = rng.standard_normal((2, v, 4 * h)) * 0.3
        x[:, :, h : 2 * h] += 1.0  # forget gate open at first
        self.p = {"x": x, "u": u, "wo": rng.standard_normal((2 * h, k)) / np.sqrt(2 * h), "bo": np.zeros(k), "t": np.zeros((k, k)), "s": np.zeros(k)}
        self.p = {n: a.astype(np.float32) for n, a in self.p.items()}
        self.mask, self.smask = self._mask()
        self._codes: np.ndarray | None = None

    def _mask(self) -> tuple[np.ndarray, np.ndarray]:
        """0 where a transition is allowed: I of a kind follows only B or I of that kind. A text may begin inside a span (windows)."""
        m = np.zeros((self.k, self.k), np.float32)
        for i in range(2, self.k, 2):
            m[:, i] = NEG
            m[i - 1, i] = m[i, i] = 0
        return m, np.zeros(self.k, np.float32)

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text, by a table over code points."""
        if self._codes is None:
            t = np.full(0x3000, -1, np.int16)
            for c, k in self.chars.items():
                if ord(c) < len(t):
                    t[ord(c)] = k
            for o in range(len(t)):
                if t[o] < 0:
                    t[o] = char_class(chr(o))
            self._codes = t
        o = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(o < len(self._codes), self._codes[np.minimum(o, len(self._codes) - 1)], 5).astype(np.int16)

    def dump(self) -> bytes:
        out = io.BytesIO()
        about = {"kinds": self.kinds, "hidden": self.hidden, "chars": "".join(self.chars)}
        np.savez_compressed(out, about=np.frombuffer(json.dumps(about).encode(), np.uint8), **{k: v.astype(np.float16) for k, v in self.p.items()})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> "Tagger":
        z = np.load(io.BytesIO(data))
        about = json.loads(z["about"].tobytes())
        t = Tagger(about["kinds"], about["chars"], about["hidden"])
        t.p = {k: z[k].astype(np.float32) for k in t.p}
        return t

    # forward pass ---------------------------------------------------------------------------------------------------

    def emissions(self, sym: np.ndarray) -> np.ndarray:
        """(n, length, tags) of a batch of symbol rows (n, length), padded with 0 at their ends; padding leaves no trace."""
        n, length = sym.shape
        lens = (sym != 0).sum(1)
        padded = length - lens.min()
        h = self.hidden
        # Gates lie one after another, so that each is a whole block of memory. sigmoid(z) = (1 + tanh(z / 2)) / 2: one tanh
        # for all; the halves of the gates are taken at the cell and, for the output gate, in the weights behind it.
        x = np.ascontiguousarray(self.p["x"].reshape(2, -1, 4, h).transpose(0, 2, 1, 3))
        u = np.ascontiguousarray(self.p["u"].reshape(2, h, 4, h).transpose(2, 0, 1, 3)) * np.float32(0.5)
        x[:, :3] *= 0.5
        u[:3] *= 0.5
        hs = np.empty((length, 2, n, h), np.float32)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        z = np.empty((4, 2, n, h), np.float32)
        own, tmp = np.empty((4, n, h), np.float32), np.empty((2, n, h), np.float32)
        st = np.ascontiguousarray(sym.T).astype(np.intp)
        for t in range(length):
            np.matmul(state[None], u, out=z)
            for d, at in ((0, t), (1, length - 1 - t)):
                np.take(x[d], st[at], axis=1, out=own, mode="clip")
                np.add(z[:, d], own, out=z[:, d])
            np.tanh(z, out=z)
            np.add(z[:3], 1.0, out=z[:3])
            np.multiply(cell, z[1], out=cell)
            np.multiply(z[0], z[3], out=tmp)
            np.add(cell, tmp, out=cell)
            np.multiply(cell, 0.5, out=cell)
            np.tanh(cell, out=tmp)
            state = hs[t]
            np.multiply(tmp, z[2], out=state)
            if t < padded:  # backwards, a row begins at its own end
                state[1, lens < length - t] = cell[1, lens < length - t] = 0
        wo = self.p["wo"] * np.float32(0.5)
        return (hs[:, 0] @ wo[:h] + hs[::-1, 1] @ wo[h:] + self.p["bo"]).transpose(1, 0, 2)

    # training -------------------------------------------------------------------------------------------------------

    def loss(self, sym: np.ndarray, tags: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character and its gradient. ``valid``: (n, length), true up to each row's end."""
        n, length = sym.shape
        h, p = self.hidden, self.p
        hs = np.zeros((length + 1, 2, n, h), np.float32)
        cs, tc = np.zeros_like(hs), np.zeros_like(hs)
        gates = np.empty((length, 2, n, 4 * h), np.float32)
        st = sym.T
        for t in range(length):
            z = np.matmul(hs[t], p["u"])
            z[0] += p["x"][0][st[t]]
            z[1] += p["x"][1][st[length - 1 - t]]
            z[..., : 3 * h] = 0.5 * (1 + np.tanh(0.5 * z[..., : 3 * h]))
            z[..., 3 * h :] = np.tanh(z[..., 3 * h :])
            gates[t] = z
            cs[t + 1] = z[..., h : 2 * h] * cs[t] + z[..., :h] * z[..., 3 * h :]
            tc[t + 1] = np.tanh(cs[t + 1])
            hs[t + 1] = z[..., 2 * h : 3 * h] * tc[t + 1]
        both = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], -1)  # length, n, 2h
        e = both @ p["wo"] + p["bo"]
        ll, de, dt, ds = self._crf(e, tags.T, valid.T)
        g = {"wo": np.tensordot(both, de, ((0, 1), (0, 1))), "bo": de.sum((0, 1)), "t": dt, "s": ds}
        db = de @ p["wo"].T
        d_out = np.stack([db[..., :h], db[::-1, :, h:]], 1)  # length, 2, n, h
        dz_all = np.empty_like(gates)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        ut = p["u"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            i, f, o, c = (gates[t][..., k * h : (k + 1) * h] for k in range(4))
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc[t + 1] ** 2)
            dz = dz_all[t]
            dz[..., :h] = dc * c * i * (1 - i)
            dz[..., h : 2 * h] = dc * cs[t] * f * (1 - f)
            dz[..., 2 * h : 3 * h] = dh * tc[t + 1] * o * (1 - o)
            dz[..., 3 * h :] = dc * i * (1 - c * c)
            dh = np.matmul(dz, ut)
            dc = dc * f
        g["u"] = np.stack([hs[:-1, d].reshape(-1, h).T @ dz_all[:, d].reshape(-1, 4 * h) for d in range(2)])
        g["x"] = np.zeros_like(p["x"])
        for d, s in ((0, st), (1, st[::-1])):
            flat = s.reshape(-1)
            order = np.argsort(flat, kind="stable")
            who, at = np.unique(flat[order], return_index=True)
            g["x"][d][who] = np.add.reduceat(dz_all[:, d].reshape(-1, 4 * h)[order], at, axis=0)
        return ll, g

    def _crf(self, e: np.ndarray, tags: np.ndarray, valid: np.ndarray):
        length, n, k = e.shape
        tr, st = self.p["t"] + self.mask, self.p["s"] + self.smask
        top = lambda a, ax: (m := a.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(a - m).sum(ax))
        al = np.empty_like(e)
        al[0] = st + e[0]
        for t in range(1, length):
            al[t] = np.where(valid[t][:, None], top(al[t - 1][:, :, None] + tr, 1) + e[t], al[t - 1])
        z = top(al[-1], 1)
        be = np.zeros_like(e)
        pair = np.zeros((k, k), np.float32)
        for t in range(length - 1, 0, -1):
            v = valid[t][:, None]
            nxt = e[t] + be[t]
            q = np.exp(al[t - 1][:, :, None] + tr + nxt[:, None, :] - z[:, None, None])
            pair += (q * v[:, :, None]).sum(0)
            be[t - 1] = np.where(v, top(tr + nxt[:, None, :], 2), be[t])
        marg = np.exp(al + be - z[None, :, None]) * valid[..., None]
        gold = np.zeros_like(e)
        np.put_along_axis(gold, tags[..., None], 1, -1)
        gold *= valid[..., None]
        gp = np.zeros((k, k), np.float32)
        both = valid[1:]
        np.add.at(gp, (tags[:-1][both], tags[1:][both]), 1)
        gs = np.bincount(tags[0], minlength=k).astype(np.float32)
        total = valid.sum()
        score = (e * gold).sum() + (gp * tr).sum() + (gs * st).sum()
        return float((z.sum() - score) / total), (marg - gold) / total, (pair - gp) / total, (marg[0].sum(0) - gs) / total

    def train(self, batches, rate: float = 0.01) -> list[float]:
        """Adam over ``batches`` (a list of (symbols, tags, valid)), with a rate that falls to a twentieth."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        losses, steps = [], len(batches)
        for t, batch in enumerate(batches, 1):
            ll, g = self.loss(*batch)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            cut, lr = min(1.0, 1.0 / (norm + 1e-9)), rate * max(0.05, 0.5 * (1 + np.cos(np.pi * t / steps))) * min(1, t / 20)
            for k, a in g.items():
                a = a * cut
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            losses.append(ll)
        return losses

    # decoding -------------------------------------------------------------------------------------------------------

    def viterbi(self, es: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of texts given their emissions (length, tags), longest first.

        Going forward only the best scores are kept; going back the best step is found again for the one tag chosen.
        """
        tr = self.p["t"] + self.mask
        start = self.p["s"].copy()
        start[2::2] = NEG  # a whole text does not begin inside a span
        n, k, length = len(es), self.k, len(es[0])
        lens = np.array([len(e) for e in es])
        score = np.zeros((length, k, n), np.float32)  # emissions at first, then scores
        for j, x in enumerate(es):
            score[: len(x), :, j] = x
        score[0] += start[:, None]
        step = tr[:, :, None]
        s = np.empty((k, k, n), np.float32)
        best = np.empty((k, n), np.float32)
        active = np.searchsorted(-lens, -np.arange(length), side="left")  # texts longer than t
        for t in range(1, length):
            a = active[t]
            np.add(score[t - 1, :, None, :a], step, out=s[..., :a])
            s[..., :a].max(0, out=best[:, :a])
            score[t, :, :a] += best[:, :a]
        out = np.zeros((length, n), np.int8)
        rows = np.arange(n)
        cur = score[lens - 1, :, rows].argmax(1)
        into = np.ascontiguousarray(tr.T)
        for t in range(length - 1, -1, -1):
            a = active[t]
            out[t, :a] = cur[:a]
            if t:
                cur[:a] = (score[t - 1, :, :a] + into[cur[:a]].T).argmax(0)
        return [out[:m, j] for j, m in enumerate(lens)]

    def tag(self, texts: list[str], window: int = 512, overlap: int = 48, batch: int = 128, group: int = 400_000, long: int = 20_000) -> list[np.ndarray]:
        """Tags of whole texts of any length; those of more than ``long`` characters one by one."""
        one_thread()
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        part: list[int] = []
        size = 0
        for k in order:
            if not texts[k]:
                out[k] = np.zeros(0, np.int8)
                continue
            if len(texts[k]) > long:
                out[k] = self._tag_long(texts[k], window, overlap, batch)
                continue
            part.append(k)
            size += len(texts[k])
            if size > group or len(part) * len(texts[part[0]]) > 2 * group:
                self._tag(texts, part, out, window, overlap, batch)
                part, size = [], 0
        if part:
            self._tag(texts, part, out, window, overlap, batch)
        return out

    def _tag_long(self, text: str, window: int, overlap: int, batch: int) -> np.ndarray:
        """Tags of one text by the same windows and one path, with the emissions of a batch of windows in memory at a time.

        Only the steps back are kept for the whole text. Scores are taken from the best one, or they would outgrow float32.
        """
        sym, step = self.encode(text), window - overlap
        n = len(sym)
        trt = np.ascontiguousarray((self.p["t"] + self.mask).T)
        score = self.p["s"].copy()
        score[2::2] = NEG
        back, tags = np.zeros((n, self.k), np.int8), np.zeros(n, np.int8)
        starts = range(0, max(1, n - overlap), step)
        lo, total, weight = 0, np.zeros((0, self.k), np.float32), np.zeros((0, 1), np.float32)  # sums from lo on
        for b in range(0, len(starts), batch):
            mine = starts[b : b + batch]
            more = min(mine[-1] + window, n) - lo - len(total)
            total, weight = (np.concatenate([x, np.zeros((more, x.shape[1]), np.float32)]) for x in (total, weight))
            rows = np.zeros((len(mine), min(window, n)), np.int16)
            for r, a in enumerate(mine):
                x = sym[a : a + window]
                rows[r, : len(x)] = x
            self._add(self.emissions(rows), [(a - lo, min(window, n - a), a > 0, a + window < n) for a in mine], [total] * len(mine), [weight] * len(mine), overlap)
            done = (starts[b + batch] if b + batch < len(starts) else n) - lo
            for t, e in enumerate(total[:done] / weight[:done], lo):
                if t:
                    s = score + trt
                    back[t] = s.argmax(1)
                    score = s.max(1)
                score = score + e
                score -= score.max()
            lo, total, weight = lo + done, total[done:], weight[done:]
        cur = int(score.argmax())
        for t in range(n - 1, -1, -1):
            tags[t] = cur
            cur = back[t, cur]
        return tags

    @staticmethod
    def _add(e, places, totals, weights, overlap) -> None:
        """Adds the emissions of windows to the sums of their texts. ``places``: start, length, whether text goes before and after."""
        ramp = np.arange(1, overlap + 1, dtype=np.float32)[:, None] / (overlap + 1)
        for r, ((a, m, before, after), total, weight) in enumerate(zip(places, totals, weights)):
            w = np.ones((m, 1), np.float32)
            if before:
                w[:overlap] = ramp[: min(overlap, m)]
            if after:
                w[-overlap:] = np.minimum(w[-overlap:], ramp[::-1])
            total[a : a + m] += e[r, :m] * w
            weight[a : a + m] += w

    def _tag(self, texts, part, out, window, overlap, batch) -> None:
        syms = [self.encode(texts[k]) for k in part]
        step = window - overlap
        jobs = [(j, a) for j, s in enumerate(syms) for a in range(0, max(1, len(s) - overlap), step)]
        jobs.sort(key=lambda x: min(window, len(syms[x[0]]) - x[1]))
        total = [np.zeros((len(s), self.k), np.float32) for s in syms]
        weight = [np.zeros((len(s), 1), np.float32) for s in syms]
        for b in range(0, len(jobs), batch):
            mine = jobs[b : b + batch]
            length = max(min(window, len(syms[j]) - a) for j, a in mine)
            sym = np.zeros((len(mine), length), np.int16)
            for r, (j, a) in enumerate(mine):
                x = syms[j][a : a + window]
                sym[r, : len(x)] = x
            places = [(a, min(window, len(syms[j]) - a), a > 0, a + window < len(syms[j])) for j, a in mine]
            self._add(self.emissions(sym), places, [total[j] for j, _ in mine], [weight[j] for j, _ in mine], overlap)
        for k, tags in zip(part, self.viterbi([t / w for t, w in zip(total, weight)])):
            out[k] = tags

    def spans(self, tags: np.ndarray) -> list[tuple[int, int, str]]:
        """(start, end, kind) of each span of a tag row."""
        on = np.flatnonzero(tags)
        out: list[list] = []
        for k in on:
            t = int(tags[k])
            kind = (t - 1) // 2
            if out and t % 2 == 0 and out[-1][1] == k and out[-1][2] == kind:
                out[-1][1] = int(k) + 1
            else:
                out.append([int(k), int(k) + 1, kind])
        return [(a, b, self.kinds[c]) for a, b, c in out]
