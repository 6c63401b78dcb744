"""Secret scans by grammar inference.

Labelled credentials (made here by seeded rules for each family, none of them real) give a prefix tree with
counts. States whose futures are statistically compatible, by Hoeffding's bound, are merged into a
probabilistic automaton for each family. Every candidate token of a text is then scored by how much likelier
its best format makes it than a model of ordinary tokens does. The fixed base patterns come first; the method
adds spans that don't overlap theirs.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm.common import map_text, table

KINDS = ("assign", "access", "hex", "format")
#: Base patterns (fixed values): letters of the key in either case, ASCII only.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run that is too short holds no match that is long enough
HEX = re.compile(r"[0-9a-f]{16,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Candidates: whole tokens of so many characters.
LEAST = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST},}}+")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM = UPPER + LOWER + DIGITS


def labelled_credentials(per_family: int = 300, seed: int = 7) -> dict[str, list[str]]:
    """Invented credentials, each with its family's form; at most per_family of each."""
    rng = random.Random(seed)
    some = lambda alphabet, *n: "".join(rng.choices(alphabet, k=rng.choice(n)))
    forms = {
        "hex_lower": lambda: some(DIGITS + "abcdef", 32, 40, 48, 64),
        "hex_upper": lambda: some(DIGITS + "ABCDEF", 32, 40, 48, 64),
        "access_key": lambda: rng.choice(["AKIA", "ASIA"]) + some(UPPER + "234567", 16),
        "base64": lambda: some(ALNUM + "+/", 32, 40, 43, 44, 64) + rng.choice(["", "=", "=="]),
        "alnum": lambda: some(ALNUM, 24, 32, 36, 40),
        "forge_token": lambda: rng.choice(["ghp_", "gho_", "ghs_", "glpat-"]) + some(ALNUM, 20, 36),
        "live_key": lambda: rng.choice(["sk_live_", "pk_live_", "sk_test_", "rk_live_"]) + some(ALNUM, 24, 32),
        "chat_token": lambda: rng.choice(["xoxb-", "xoxp-"]) + some(DIGITS, 11, 12) + "-" + some(DIGITS, 11, 12) + "-" + some(ALNUM, 24),
        "web_key": lambda: "AIza" + some(ALNUM + "_-", 35),
        "signed_token": lambda: "eyJ" + some(ALNUM + "_-", 20, 33) + ".eyJ" + some(ALNUM + "_-", 40, 70) + "." + some(ALNUM + "_-", 43),
    }
    return {k: [f() for _ in range(per_family)] for k, f in forms.items()}


def ordinary_tokens(n: int = 12_000, seed: int = 8) -> list[str]:
    """Tokens that are no credentials: words and compounds, names in code, addresses, dates, versions, numbers, paths, rules."""
    rng = random.Random(seed)
    syllables = "the and ing ion tion er re on at en ed th ou le la de el un ver ge ich ung ado que os ar ment eau mail host example com org net www page item data test user file main list node".split()
    morphemes = (
        "anti auto bi co con counter de dis electro ex extra hyper in inter intra macro mega micro mis multi non over para photo poly post pre pro pseudo re semi sub super tele trans ultra un under"
        " able al ance ation dom ence er ery ess est ful hood ible ic ical ies ing ion ise ish ism ist ity ive ize less ly ment ness or ous ship ty ure ward wise straight forward stand build work light water house play thing time"
        " ab an auf aus be bei durch ein ent er fort ge her hin mit nach um unter ver vor weg wieder zer zu bar chen haft heit ig in isch keit lein lich los nis sal sam schaft tum ung bahn berg blatt buch burg dampf donau fahrt feld freund geld gesell haus hof jahr kraft land leben markt mensch rat recht schiff schule schutz spiel sprache stadt stein tag tor verein versicherung wasser weg werk wort zeit sch ch pf tz sp st ei au eu"
        " age aille ais ateur ation ement ence esse ette eur euse ien ier ille ique isme iste ité oir tion ure constitu nel le aux eaux ador aje ante ario ción dad dero encia ez ía ismo ista mente miento or oso ura graf electr fica"
        " get set add make is has to from by of on factory bean proxy abstract base manager handler listener event element class name value index builder service request response context config state string array map list size max min count per connection session cache buffer stream reader writer source target settings profile template resource concurrent lock util"
    ).split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    compound = lambda: "".join(rng.choices(morphemes, k=rng.randint(3, 8)))
    num = lambda a, b: str(rng.randint(10**a, 10**b))
    forms = [
        lambda: f"{word()}.{num(0, 3)}.{word()}.com", lambda: f"{word()}{num(0, 2)}.{word()}.{rng.choice(['com', 'org', 'net'])}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{num(1, 2)}", lambda: ".".join(num(0, 2) for _ in range(4)),
        lambda: f"{word()}_{word()}_{num(0, 4)}", lambda: f"{word()}-{word()}-{num(0, 4)}", lambda: f"/{word()}/{word()}/{num(0, 5)}.html",
        lambda: num(8, 20), lambda: word().capitalize() + word().capitalize() + num(0, 3), lambda: f"{word()}{word()}{word()}{num(0, 2)}",
        lambda: f"v{num(0, 1)}.{num(0, 2)}.{num(0, 2)}-{word()}{num(0, 1)}", lambda: f"{num(2, 3)}-{num(2, 3)}-{num(3, 4)}", lambda: word().upper() + "_" + word().upper() + num(0, 2),
        compound, compound, lambda: compound().capitalize(), lambda: compound().upper() + rng.choice(["", "."]), lambda: rng.choice("-_./").join(rng.choices(morphemes, k=rng.randint(3, 6))),
        lambda: rng.choice(["", "get", "is"]) + "".join(x.capitalize() for x in rng.choices(morphemes, k=rng.randint(2, 6))), lambda: rng.choice(LOWER + UPPER + "-_./=+") * rng.randint(16, 40),
    ]
    return [rng.choice(forms)() for _ in range(n)]


class Automaton:
    """A probabilistic automaton merged from a prefix tree: states (visits, ends, {symbol: (count, state)})."""

    #: A symbol or end that a state has never shown gets this share.
    UNSEEN = 1e-5

    def __init__(self, words: list[str], alpha: float = 0.05):
        self.visits, self.ends, self.next = [0], [0], [{}]
        for w in words:
            s = 0
            self.visits[0] += 1
            for c in w:
                n, t = self.next[s].get(c, (0, len(self.visits)))
                if not n:
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                self.next[s][c] = (n + 1, t)
                s = t
                self.visits[s] += 1
            self.ends[s] += 1
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[0] if x else 0, n, y[0] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[1], y[1]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (n, t) in self.next[b].items():
                if c in self.next[a]:
                    m, s = self.next[a][c]
                    self.next[a][c] = (n + m, s)
                    todo.append((s, t))
                else:
                    self.next[a][c] = (n, t)

    def _infer(self) -> None:
        red = [0]
        while True:
            blue = [(s, c, t) for s in red for c, (_, t) in self.next[s].items() if t not in red]
            if not blue:
                break
            s, c, t = max(blue, key=lambda x: (self.visits[x[2]], -x[2]))
            for r in red:
                if self._compatible(r, t):
                    self.next[s][c] = (self.next[s][c][0], r)
                    self._fold(r, t)
                    break
            else:
                red.append(t)
        self.red = red
        self.logs = {s: ({c: (math.log(n / self.visits[s]), t) for c, (n, t) in self.next[s].items()}, math.log(max(self.ends[s] / self.visits[s], self.UNSEEN))) for s in red}

    def score(self, word: str) -> float:
        """The log likelihood of a word."""
        s, total, unseen = 0, 0.0, math.log(self.UNSEEN)
        for c in word:
            step = self.logs[s][0].get(c)
            if step is None:
                total += unseen
            else:
                total += step[0]
                s = step[1]
        return total + self.logs[s][1]


class Background:
    """Character trigrams of ordinary tokens, mixed with single characters; digits are alike."""

    SHARES = (0.7, 0.28, 0.02)

    def __init__(self, words: list[str]):
        self.one: dict = {}
        self.two: dict = {}
        self.three: dict = {}
        for w in map(self._plain, words):
            for i in range(2, len(w)):
                for counts, key in ((self.one, w[i]), (self.two, w[i - 2 : i]), (self.three, w[i - 2 : i + 1])):
                    counts[key] = counts.get(key, 0) + 1
        self.all = sum(self.one.values())

    @staticmethod
    def _plain(w: str) -> str:
        return "^^" + re.sub("[0-9]", "0", w) + "$"

    def score(self, word: str) -> float:
        w, (a, b, c) = self._plain(word), self.SHARES
        total = -math.log(10) * w.count("0")
        for i in range(2, len(w)):
            n = self.two.get(w[i - 2 : i], 0)
            total += math.log(a * (self.three.get(w[i - 2 : i + 1], 0) / n if n else 0) + b * self.one.get(w[i], 0) / self.all + c / 66)
        return total


class Scanner:
    """THRESHOLD: nats by which the best format must beat the background, and so many for each character."""

    THRESHOLD, PER_CHARACTER = 5.0, 0.25

    def __init__(self):
        self.formats = {k: Automaton(v) for k, v in labelled_credentials().items()}
        self.background = Background(ordinary_tokens())

    def score(self, token: str) -> tuple[float, str]:
        """How much likelier the best format makes a token than the background does, and that format."""
        best, name = max((a.score(token), k) for k, a in self.formats.items())
        return best - self.background.score(token), name

    def base(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        low = text.lower()  # ASCII letters always become their small letters, so this loses no key
        if any(k in low for k in KEYS):
            out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))

    def scan(self, text: str) -> list[tuple[int, int, str, float | None, str | None]]:
        """(start, end, kind, score, format) in order of start, then kind; ends are exclusive."""
        base = self.base(text)
        out: list = [(*x, None, None) for x in base]
        for m in CANDIDATE.finditer(text):
            token = m[0].rstrip(".=-") if m[0][-1] in ".-" else m[0]
            start, end = m.start(), m.start() + len(token)
            if len(token) < LEAST or any(s < end and start < e for s, e, _ in base):
                continue
            score, name = self.score(token)
            if score >= self.THRESHOLD + self.PER_CHARACTER * len(token):
                out.append((start, end, "format", score, name))
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


@lru_cache(1)
def scanner() -> Scanner:
    """One scanner for each Python worker; its training data and seeds are fixed, so all are alike."""
    return Scanner()


SPAN = "array<struct<kind:string,start:int,end:int,score:double,format:string>>"


def scan(df: DataFrame, text: str = "text", out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """Add the spans found in whole texts (code points, end exclusive); base spans have no score.

    Null texts have none. A clashing column gives way; other columns and repeated rows pass.
    """

    def make():
        s = scanner()
        return lambda texts: [[[{"kind": k, "start": a, "end": b, "score": x, "format": f} for a, b, k, x, f in s.scan((t or b"").decode(errors="replace"))] for t in texts]]

    return map_text(df, text, f"`{out}` {SPAN}", make, keep)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Put `mark` in place of each span (overlapping ones are one); null texts stay null."""

    def clean(t: bytes | None) -> str | None:
        if t is None:
            return None
        t, at, parts = t.decode(errors="replace"), 0, []
        for start, end, *_ in scanner().scan(t):
            if start >= at:
                parts += [t[at:start], mark]
            at = max(at, end)
        return "".join([*parts, t[at:]])

    cols = df.columns
    return map_text(df, text, f"`{text}` string", lambda: lambda texts: [[clean(t) for t in texts]]).select(*(F.col(f"`{c}`") for c in cols))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its spans; scan() says what becomes of nulls. Spans that start together go by kind, repeated rows get
    equal ones, a null id stays null; an empty table gives an empty result. Tokens of fewer than LEAST characters are scored by
    no automaton: the base patterns alone see them."""
    got = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    n = lambda kind: F.size(F.filter("secrets", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x["end"].cast("string"))), ",")
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spelled(F.filter("secrets", lambda x: x.kind != "format")), 256).alias("base_sha256"), spelled("secrets").alias("spans"))


QUERIES = {"op4_secrets": op4_secrets}
ORACLE_SQL: dict[str, str] = {}
