"""Personal data: fixed base patterns, and a tagger of characters that finds the forms they don't know.

The tagger is a bidirectional LSTM over characters with a linear-chain CRF on top, trained here in numpy from
labelled spans that seeded rules make (none of them real). It reads overlapping windows; each is decoded by
itself, and all spans of a text are then reconciled at once: of the spans that pass their kind's exact check the
set without overlaps that is likeliest in sum stays, and none of it touches a base span.

Windows lie around marks: digits, at signs, words that stand for the sign or for a dot, and colons of addresses. No kind's exact
check passes a span without a mark, so text without marks needs no window; whole texts are scanned for marks.
"""

from __future__ import annotations

import ipaddress
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm.common import map_text, table

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed values); digits and letters are ASCII. Possessive, so that time is linear in a text.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

AT = r"(?:@|[(\[{<]\s?(?:at|AT|At|arroba)\s?[)\]}>]|\s(?:at|AT|arroba)\s)"
DOT = r"(?:\s?\.\s?|\s?[(\[{<]\s?(?:dot|DOT|punto|\.)\s?[)\]}>]\s?|\s(?:dot|DOT|punto)\s)"
#: What every span that valid() lets stay holds at least one of: a sign, its spellings (as a bare word only before a host with a
#: dot), a digit, or three colons of an address without digits.
MARK = re.compile(rf"[0-9@]|[(\[{{<]\s?(?:at|AT|At|arroba)\s?[)\]}}>]|\b(?:dot|DOT|punto)\b|\s(?:at|AT|arroba)\s\s?[A-Za-z0-9-]++{DOT}[A-Za-z0-9-]|:[A-Fa-f]{{0,4}}:[A-Fa-f]{{0,4}}:")
SPELLED = re.compile(rf"[A-Za-z0-9_%+-]+(?:(?:\.|{DOT})[A-Za-z0-9_%+-]+)*\s?{AT}\s?[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"\(?[0-9][0-9 ().\-/]*[0-9]")
GROUPS = re.compile(r"[0-9](?:[ ./_\- \n]{0,2}[0-9])+")
QUAD = re.compile(r"([0-9]{1,3})(?:\[\.\]|\(\.\)|\s?\.\s?|\[dot\])([0-9]{1,3})(?:\[\.\]|\(\.\)|\s?\.\s?|\[dot\])([0-9]{1,3})(?:\[\.\]|\(\.\)|\s?\.\s?|\[dot\])([0-9]{1,3})")


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return sum(d[0::2], sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def plain_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and without overlaps in a kind; failing matches are dropped."""
    out, done, last = [], 0, 0
    at = text.find("@")
    while at >= 0:  # a local part reaches back to what is no letter of it, the match before, or the sign before
        low = max(done, last)
        start = low + len(text[low:at].rstrip(LOCAL))
        if start < at and (m := HOST.match(text, at)):
            out.append((start, m.end(), "email"))
            done = m.end()
        last = at + 1
        at = text.find("@", max(last, done))
    small = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or "0") <= 255
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= len(d := plain_digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(plain_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def valid(kind: str, span: str, before: str, after: str) -> bool:
    """The exact check of a tagged span between its two neighbours: what no tagger can know (check digits, ranges)."""
    if before.isalnum() or after.isalnum():
        return False
    n = plain_digits(span)
    if kind == "email":
        return SPELLED.fullmatch(span) is not None
    if kind == "card":
        return GROUPS.fullmatch(span) is not None and 12 <= len(n) <= 19 and len(set(n)) > 1 and luhn(n)
    if kind == "phone":
        return NUMBER.fullmatch(span) is not None and 8 <= len(n) <= 15 and before not in ("+", "$", "€", "£", "#", ".", "-", "/", ":") and after not in ("%", "-", "/", ":")
    if m := QUAD.fullmatch(span):
        return all(int(x) <= 255 for x in m.groups())
    try:
        return span.count(":") >= 3 and ipaddress.ip_address(span).version == 6 and before != ":" and after != ":"
    except ValueError:
        return False


#: Symbols: printable ASCII each by itself, then blank, line end, other small letter, other letter, other digit, padding, other.
_PLAIN = {chr(c): c - 33 for c in range(33, 127)}
BLANK, LINE, SMALL, CAPITAL, DIGIT, PAD, OTHER = range(94, 101)
SYMBOLS = 101
TAGS = ["O"] + [f"{x}-{k}" for k in KINDS for x in "BI"]


@lru_cache(1 << 14)
def symbol(c: str) -> int:
    if (x := _PLAIN.get(c)) is not None:
        return x
    return LINE if c in "\n\r" else BLANK if c.isspace() else SMALL if c.islower() else CAPITAL if c.isalpha() else DIGIT if c.isdigit() else OTHER


def labelled_texts(n: int, seed: int = 21) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Invented texts with their spans: personal data in forms that base patterns miss, in their own forms, and
    numbers and words of other kinds."""
    rng = random.Random(seed)
    syllables = "the and ing ion tion er re on at en ed th ou le la de el un ver ge ich ung ado que os ar ment eau ó é ä ü ñ sch ent ca mi no to or is".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    some = lambda *k: "".join(rng.choices("0123456789", k=rng.choice(k)))
    name = lambda: re.sub("[^a-z]", "", word()) or "ana"
    user = lambda: rng.choice([name(), name() + rng.choice("._-") + name(), name() + some(1, 2, 4)])
    top = lambda: rng.choice("com org net de fr es io edu info".split())

    def spelled() -> str:
        at = rng.choice([" at ", " AT ", "(at)", "[at]", " (at) ", " [at] ", "{at}", " @ ", " arroba ", "<at>", " {at} "])
        dot = rng.choice([" dot ", " DOT ", "(dot)", "[dot]", " (dot) ", " [dot] ", ".", " . ", "[.]", " punto "])
        if at.strip() in ("at", "AT", "arroba") and dot.strip() == ".":
            dot = " dot "
        return user() + at + dot.join([name() + rng.choice(["", some(1)]), *([name()] if rng.random() < 0.3 else []), top()])

    octet = lambda: str(rng.randint(0, 255))

    def address() -> str:
        if rng.random() < 0.4:
            parts = [f"{rng.randint(0, 65535):x}" for _ in range(8)]
            cut = rng.randint(1, 6)
            return ":".join(parts) if rng.random() < 0.5 else ":".join(parts[:cut]) + "::" + ":".join(parts[cut + rng.randint(1, 2) :][-rng.randint(1, 4) :] or ["1"])
        return rng.choice(["[.]", "(.)", " . ", "[dot]"]).join(octet() for _ in range(4))

    def card() -> str:
        d = rng.choice(["4", "51", "37", "6011", "35"]) + some(11, 12, 10)
        d += next(str(x) for x in range(10) if luhn(d + str(x)))
        sep = rng.choice([".", "/", "_", "  ", " - ", " ", "."])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = some(3), some(3), some(4)
        return rng.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"{a} {b} {c}", f"00{some(2)} {some(2, 3)} {some(3, 4)} {some(3, 4)}", f"0{some(2, 3)}/{some(6, 7)}", f"0{some(3)} {some(6, 7)}", "0" + rng.choice("1234567") + (s := rng.choice([" ", "."])) + s.join(some(2) for _ in range(4)), f"1-{a}-{b}-{c}", f"(0{some(2)}) {some(4)} {some(4)}"])

    cue = {"email": ["", "", "mail ", "Mail: ", "write to ", "e-mail: ", "contact ", "à ", "an "], "ip": ["", "", "host ", "IP: ", "from ", "server "], "card": ["", "", "card ", "Card: ", "Visa ", "carte ", "tarjeta ", "no. "], "phone": ["", "", "Tel. ", "tel: ", "call ", "phone ", "Phone: ", "Telefon ", "tél. ", "fax ", "mobile "]}
    make = {"email": spelled, "ip": address, "card": card, "phone": phone}
    year = lambda: rng.randint(1900, 2040)
    ordinary = [
        lambda: f"{year()}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year()}", lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{year()}", lambda: f"{year()}-{year()}",
        lambda: f"{year()}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{some(2)}:{some(2)}Z", lambda: f"{rng.randint(0, 23)}:{some(2)}", lambda: f"{rng.randint(0, 23)}:{some(2)}:{some(2)}", lambda: f"v{some(1)}.{some(1, 2)}.{some(1, 2)}", lambda: f"{some(1)}.{some(1, 2)}.{some(1)}", lambda: f"${some(2, 3)}.{some(2)}", lambda: f"{some(1, 2)},{some(3)},{some(3)}", lambda: f"{some(1, 2)}.{some(3)}.{some(3)}",
        lambda: some(1, 2, 3, 4, 5, 6), lambda: some(7, 8, 9, 10, 12), lambda: some(14, 16, 18, 20), lambda: f"978-{some(1)}-{some(2)}-{some(6)}-{some(1)}", lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([8, 16, 32, 40]))), lambda: f"{some(1)}.{some(2)}e-{some(1)}", lambda: f"{some(1, 2)} %", lambda: f"{name()}{some(1, 2)}", lambda: f"§ {some(1, 3)}",
        lambda: f"{some(3)} x {some(3)}", lambda: f"{some(1)}. {word()}", lambda: f"[{some(1, 2)}]", lambda: f"No. {some(4, 6, 8)}", lambda: f"#{some(4, 5, 6)}", lambda: f"10.{some(4)}/{name()}.{some(4)}.{some(2)}", lambda: f"https://{name()}.{top()}/{name()}/{some(3, 6)}", lambda: f"{word()} at {word()}", lambda: f"@{name()}", lambda: f"{name()} dot {word()}", lambda: f"{some(2)}:{some(2)}:{some(2)}:{some(2)}", lambda: f"{word()} at {some(1, 2)}:{some(2)}",
        lambda: f"{some(3)}, {some(3)}, {some(3)}", lambda: f"{some(2)} {some(2)} {some(2)}", lambda: f"{some(1, 2)}-{some(1, 2)}", lambda: f"{some(3)} - {some(3)} = {some(3)}", lambda: f"({some(1, 2)})", lambda: f"({year()}) {some(2, 3)}-{some(3)}", lambda: f"{some(5)}-{some(4)}", lambda: f"{some(3)}-{some(2)}.{some(3)}", lambda: f"{some(1)} {some(3)} {some(3)}", lambda: f"{some(2)} {some(3)} {some(3)} €", lambda: rng.choice(["a", "hash", "token = "]) + '"' + "".join(rng.choices("0123456789abcdef", k=40)) + '"',
    ]
    own = {"email": lambda: f"{user()}@{name()}.{top()}", "ip": lambda: ".".join(octet() for _ in range(4)), "card": lambda: some(16), "phone": lambda: f"+{some(1, 2)} ({some(3)}) {some(3)}-{some(4)}"}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 2)):
            text += " ".join(word() for _ in range(rng.randint(0, 4)))
            text += rng.choice([" ", " ", " ", ", ", ". ", "\n", ": ", " (", ' "', " | "]) if text else ""
            r = rng.random()
            if r < 0.5:
                kind = rng.choice(KINDS)
                text += rng.choice(cue[kind])
                x = make[kind]()
                spans.append((len(text), len(text) + len(x), kind))
            elif r < 0.58:  # what the base knows is personal data here too
                kind = rng.choice(KINDS)
                x = own[kind]()
                if kind != "card":
                    spans.append((len(text), len(text) + len(x), kind))
            else:
                x = rng.choice(ordinary)()
            text += x + rng.choice([" ", " ", " ", ". ", ", ", "\n", ") ", "; ", '" '])
        text += " ".join(word() for _ in range(rng.randint(0, 3)))
        if rng.random() < 0.1:
            text, spans = (text.upper(), spans) if len(text.upper()) == len(text) else (text, spans)
        out.append((text, spans))
    return out


class Tagger:
    """Bidirectional LSTM with `hidden` cells a direction, and a CRF over TAGS. Symbols are looked up as what they add to
    the gates. Weights of the gates i, f, o are halved where they are used: a sigmoid is a scaled tanh."""

    #: The longest gradient that is followed as it is.
    STEEP = 20.0

    def __init__(self, hidden: int = 24, seed: int = 5):
        r, k = np.random.default_rng(seed), len(TAGS)
        near = lambda *shape: (r.standard_normal(shape) * 0.15).astype(np.float32)
        self.h = hidden
        self.w = {"x": near(2, SYMBOLS, 4 * hidden), "u": near(2, hidden, 4 * hidden), "out": near(2 * hidden, k), "bias": np.zeros(k, np.float32), "move": np.zeros((k, k), np.float32), "first": np.zeros(k, np.float32)}
        self.w["x"][:, :, hidden : 2 * hidden] += 1  # remember at first
        self.ban = np.zeros((k, k), np.float32)
        for a, x in enumerate(TAGS):
            for b, y in enumerate(TAGS):
                if y[0] == "I" and x[1:] != y[1:]:
                    self.ban[a, b] = -1e4
        self.ban_first = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)

    def _run(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (B, T, 2H) over symbols (B, T); PAD freezes nothing: windows are padded at the end only, and the second
        direction starts there from zero. With keep, what the gradient needs."""
        (b, t), h = x.shape, self.h
        both = np.stack([x, x[:, ::-1]])
        u, table_ = self.w["u"], self.w["x"]
        half = np.ones(4 * h, np.float32)
        half[: 3 * h] = 0.5
        table_, u = table_ * half, u * half
        state, cell, saved = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32), []
        out = np.empty((2, t, b, h), np.float32)
        for k in range(t):
            g = np.matmul(state, u)
            g[0] += table_[0][both[0, :, k]]
            g[1] += table_[1][both[1, :, k]]
            np.tanh(g, out=g)
            s = g[..., : 3 * h]
            s += 1
            s *= 0.5
            i, f, o, c = g[..., :h], g[..., h : 2 * h], g[..., 2 * h : 3 * h], g[..., 3 * h :]
            new = f * cell
            new += i * c
            live = np.tanh(new)
            if keep:
                saved.append((g, cell, live, state))
            cell, state = new, o * live
            out[:, k] = state
        y = np.concatenate([out[0], out[1, ::-1]], axis=2).transpose(1, 0, 2)
        return y, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._run(x, False)[0] @ self.w["out"] + self.w["bias"]

    def gradient(self, x: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tag sequences over the real places, and its gradient."""
        y, saved = self._run(x, True)
        e = y @ self.w["out"] + self.w["bias"]
        b, t, k = e.shape
        move, first = self.w["move"] + self.ban, self.w["first"] + self.ban_first
        step, far = np.exp(move), np.exp(e - e.max(2, keepdims=True))
        far[~real] = 1
        # Forward and backward sums, each place scaled to 1; padding repeats the place before.
        a, z, scale = np.empty_like(e), np.ones_like(e), np.ones((b, t), e.dtype)
        a[:, 0] = np.exp(first) * far[:, 0]
        for i in range(t):
            if i:
                a[:, i] = np.where(real[:, i, None], (a[:, i - 1] @ step) * far[:, i], a[:, i - 1])
            scale[:, i] = a[:, i].sum(1)
            a[:, i] /= scale[:, i, None]
        for i in range(t - 2, -1, -1):
            z[:, i] = np.where(real[:, i + 1, None], (far[:, i + 1] * z[:, i + 1]) @ step.T / scale[:, i + 1, None], z[:, i + 1])
        total = (np.log(scale) + e.max(2) * real).sum(1)
        rows, places, pairs = np.arange(b)[:, None], np.arange(t), real[:, 1:]
        p = a * z * real[..., None]
        score = (e[rows, places, tags] * real).sum(1) + first[tags[:, 0]] + (move[tags[:, :-1], tags[:, 1:]] * pairs).sum(1)
        de = p.copy()
        de[rows, places, tags] -= real
        onward = far[:, 1:] * z[:, 1:] / scale[:, 1:, None] * pairs[..., None]
        joint = step * np.tensordot(a[:, :-1], onward, ((0, 1), (0, 1)))
        np.subtract.at(joint, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
        start = p[:, 0].sum(0)
        np.subtract.at(start, tags[:, 0], 1)
        de /= b
        grad = {"out": np.tensordot(y, de, ((0, 1), (0, 1))), "bias": de.sum((0, 1)), "move": joint / b, "first": start / b}
        dy = (de @ self.w["out"].T).transpose(1, 0, 2)
        h = self.h
        dout = np.stack([dy[..., :h], dy[::-1, :, h:]])  # (2, T, B, H)
        du, each = np.zeros_like(self.w["u"]), np.empty((2, t, b, 4 * h), e.dtype)
        dstate, dcell = np.zeros((2, b, h), e.dtype), np.zeros((2, b, h), e.dtype)
        ut = self.w["u"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            g, cell, live, state = saved[i]
            gi, gf, go, gc = g[..., :h], g[..., h : 2 * h], g[..., 2 * h : 3 * h], g[..., 3 * h :]
            ds = dout[:, i] + dstate
            dc = dcell + ds * go * (1 - live * live)
            d = each[:, i]
            d[..., :h], d[..., h : 2 * h], d[..., 2 * h : 3 * h], d[..., 3 * h :] = dc * gc, dc * cell, ds * live, dc * gi
            d[..., : 3 * h] *= g[..., : 3 * h] * (1 - g[..., : 3 * h])
            d[..., 3 * h :] *= 1 - gc * gc
            du += np.matmul(state.transpose(0, 2, 1), d)
            dstate, dcell = np.matmul(d, ut), dc * gf
        # Each symbol's share, as a product with which places show it.
        shown = np.zeros((SYMBOLS, t * b), e.dtype)
        shown[x.T.reshape(-1), np.arange(t * b)] = 1
        dx = np.stack([shown @ each[0].reshape(t * b, -1), shown @ each[1, ::-1].reshape(t * b, -1)])
        return float((total - score).mean()), grad | {"u": du, "x": dx}

    def train(self, texts: list, rounds: int = 6, size: int = 32, width: int = 96, rate: float = 0.025, seed: int = 9) -> Tagger:
        """Adam over shuffled batches; texts longer than width are cut there."""
        r = np.random.default_rng(seed)
        x, tags, real = encode(texts, width)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v, step = {k: np.zeros_like(w) for k, w in self.w.items()}, 0
        total = rounds * (len(x) // size + 1)
        for _ in range(rounds):
            order = r.permutation(len(x))
            parts = [p[np.argsort(real[p].sum(1), kind="stable")] for p in np.array_split(order, max(1, len(x) // (16 * size)))]  # alike in length
            batches = [p[i : i + size] for p in parts for i in range(0, len(p), size)]
            for some in (batches[i] for i in r.permutation(len(batches))):
                long = max(2, int(real[some].sum(1).max()))
                _, grad = self.gradient(x[some, :long], tags[some, :long], real[some, :long])
                step += 1
                now = rate * min(1, step / 20) * (max(0.05, 1 - step / total))
                norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
                for k, g in grad.items():
                    g = g * min(1.0, self.STEEP / (norm + 1e-9))
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.005 * (g * g - v[k])
                    self.w[k] -= (now * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best tags of each window by Viterbi, the gain of each place over tag O, and the moves' part of it."""
        e = self.emissions(x)
        b, t, k = e.shape
        move = self.w["move"] + self.ban
        best, back = e[:, 0] + self.w["first"] + self.ban_first, np.zeros((b, t, k), np.int8)
        for i in range(1, t):
            all_ = best[:, :, None] + move
            back[:, i] = all_.argmax(1)
            new = all_.max(1) + e[:, i]
            best = np.where(real[:, i, None], new, best)
            back[:, i] = np.where(real[:, i, None], back[:, i], np.arange(k, dtype=np.int8))
        tags = np.zeros((b, t), np.int64)
        tags[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[np.arange(b), i, tags[:, i]]
        gain = np.take_along_axis(e, tags[..., None], 2)[..., 0] - e[..., 0]
        moved = np.zeros_like(gain)
        moved[:, 1:] = self.w["move"][tags[:, :-1], tags[:, 1:]] - self.w["move"][0, 0]
        return tags, gain, moved


def encode(texts: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, tags, real = np.full((len(texts), width), PAD, np.int64), np.zeros((len(texts), width), np.int64), np.zeros((len(texts), width), bool)
    for i, (text, spans) in enumerate(texts):
        n = min(width, len(text))
        x[i, :n], real[i, :n] = [symbol(c) for c in text[:n]], True
        for start, end, kind in spans:
            k = 1 + 2 * KINDS.index(kind)
            tags[i, start : min(end, n)] = k + 1
            if start < n:
                tags[i, start] = k
    return x, tags, real


#: Texts that the tagger learns from.
EXAMPLES = 6000


@lru_cache(2)
def tagger(examples: int = EXAMPLES) -> Tagger:
    """The trained tagger; data and seeds are fixed."""
    return Tagger().train(labelled_texts(examples))


class Finder:
    """Characters of a window, by how many two of them overlap, characters around a mark, windows read at once, and the
    least log odds of a span against its being nothing."""

    WIDTH, OVERLAP, AROUND, BATCH, LEAST = 160, 80, 40, 128, 2.0

    def __init__(self, trained: Tagger):
        self.tagger = trained

    def windows(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
        """Overlapping windows over what lies around marks outside base spans."""
        regions: list[list[int]] = []
        ends = iter(sorted((s, e) for s, e, _ in taken))
        cur = next(ends, None)
        for m in MARK.finditer(text):
            at = m.start()
            while cur and cur[1] <= at:
                cur = next(ends, None)
            if cur and cur[0] <= at:
                continue
            low, high = max(0, at - self.AROUND), min(len(text), m.end() + self.AROUND)
            if regions and low <= regions[-1][1]:
                regions[-1][1] = high
            else:
                regions.append([low, high])
        out, step = [], self.WIDTH - self.OVERLAP
        for low, high in regions:
            at = low
            while True:
                out.append((at, min(high, at + self.WIDTH)))
                if at + self.WIDTH >= high:
                    break
                at += step
        return out

    def tagged(self, jobs: list[tuple[int, int, str]]) -> list[list[tuple[int, int, str, float]]]:
        """Spans (start and end in the window, kind, log odds) of windows (text, start) given as (key, start, characters)."""
        found: list[list] = [[] for _ in jobs]
        order = sorted(range(len(jobs)), key=lambda i: len(jobs[i][2]))
        for at in range(0, len(order), self.BATCH):
            some = order[at : at + self.BATCH]
            x, _, real = encode([(jobs[i][2], []) for i in some], max(1, len(jobs[some[-1]][2])))
            tags, gain, moved = self.tagger.decode(x, real)
            for row, i in zip(*np.nonzero((tags % 2 == 1) & real), strict=True):
                end, k = i + 1, tags[row, i]
                while end < tags.shape[1] and tags[row, end] == k + 1 and real[row, end]:
                    end += 1
                found[some[row]].append((int(i), int(end), KINDS[(k - 1) // 2], float(gain[row, i:end].sum() + moved[row, i:end].sum())))
        return found

    def scan(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base spans, added spans (start, end, kind, log odds)) of whole texts."""
        bases = [base(t) for t in texts]
        jobs = [(k, a, texts[k][a:b]) for k in range(len(texts)) for a, b in self.windows(texts[k], bases[k])]
        spans: list[dict] = [{} for _ in texts]
        for at in range(0, len(jobs), 64 * self.BATCH):
            part = jobs[at : at + 64 * self.BATCH]
            for (k, low, chars), found in zip(part, self.tagged(part), strict=True):
                for s, e, kind, odds in found:
                    t, start, end = texts[k], low + s, low + e
                    while end > start and t[end - 1] in " .,;:)\n" and not (t[end - 1] == ")" and "(" in t[start:end]):
                        end -= 1
                    while start < end and t[start] in " \n":
                        start += 1
                    if odds < self.LEAST or end <= start:
                        continue
                    passed = [x for x in (kind, "card", "ip") if valid(x, t[start:end], t[max(0, start - 1) : start], t[end : end + 1])]
                    if passed:  # the tagged kind, else one whose check leaves no doubt
                        spans[k][start, end, passed[0]] = max(odds, spans[k].get((start, end, passed[0]), 0.0))
        return [(b, reconciled(s, b)) for s, b in zip(spans, bases, strict=True)]


def reconciled(spans: dict[tuple[int, int, str], float], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """The spans of all windows of a text without overlaps that are likeliest in sum; none touches a taken one."""
    free, cover, k = [], sorted((s, e) for s, e, _ in taken), 0
    for (s, e, kind), odds in sorted(spans.items(), key=lambda x: (x[0][0], x[0][1], KINDS.index(x[0][2]))):
        while k < len(cover) and cover[k][1] <= s and (k + 1 == len(cover) or cover[k + 1][0] <= s):
            k += 1
        if not any(a < e and s < b for a, b in cover[max(0, k - 3) : k + 4]):
            free.append((s, e, kind, odds))
    free.sort(key=lambda x: (x[1], x[0], KINDS.index(x[2])))
    ends, best = [x[1] for x in free], [(0.0, -1, -1)]  # (sum, span, link before)
    for i, (s, _, _, odds) in enumerate(free):
        before = bisect_right(ends, s, 0, i)
        with_ = best[before][0] + odds
        best.append((with_, i, before) if with_ > best[-1][0] else (best[-1][0], -1, i))
    out, at = [], len(free)
    while at > 0:
        _, i, before = best[at]
        if i >= 0:
            out.append(free[i])
        at = before
    return out[::-1]


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find(df: DataFrame, text: str = "text", out: str = "personal", keep: list[str] | None = None, examples: int = EXAMPLES) -> DataFrame:
    """Add the spans found in whole texts (code points, end exclusive) by start, then kind; base spans have no score.

    Null texts count as empty and have none, nor do texts without marks. Repeated rows and equal texts get equal
    spans; clashing columns give way, others pass. An empty table gives an empty result. Time is linear in a text.
    """
    trained = tagger(examples)

    def make():
        finder = Finder(trained)

        def run(texts: list) -> list:
            rows = []
            for known, added in finder.scan([(t or b"").decode(errors="replace") for t in texts]):
                both = sorted([(s, e, k, None) for s, e, k in known] + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                rows.append([{"kind": k, "start": s, "end": e, "score": o} for s, e, k, o in both])
            return [rows]

        return run

    return map_text(df, text, f"`{out}` {SPAN}", make, keep)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`; see find() for nulls, repeats and empty tables. Counts are of base spans."""
    got = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    known = F.filter("personal", lambda x: x.score.isNull())
    n = lambda kind: F.size(F.filter(known, lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x["end"].cast("string"))), ",")
    return got.select("doc_id", *map(n, KINDS), F.sha2(spelled(known), 256).alias("base_sha256"), spelled(F.col("personal")).alias("spans"))


QUERIES = {"op12_personal_data": op12_personal_data}
ORACLE_SQL: dict[str, str] = {}
