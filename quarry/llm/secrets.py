"""Secret scans: fixed patterns, and a linear-chain conditional random field decoded by Viterbi.

The field tags every word of a text as O (outside), B (a secret begins) or I (inside one). Emissions
come from the word's shape, the neighbouring words and features of the whole file. Its weights, in
``secrets.json`` beside this module, are what ``python -m quarry.llm.secrets`` fits by maximum likelihood to
seeded generated lines (``TRAINING_LINES`` of them, no corpus rows); a test fits them again.

Scores of a word depend on its shape class alone, so they are looked up. A word at which O wins by more
than any transition could ever make good is O on the best path; the chain falls apart there, and
Viterbi runs on the short stretches between, which gives the same path as on the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import blocks, documents, slices, text_bytes

#: Fixed patterns; letters of the keywords in either case.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
#: Cheap necessary conditions of the patterns.
HINTS = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{24}"}

TRAINING_LINES, SEED = 3000, 7
O, B, I = 0, 1, 2
PROSE = re.compile(rb"[\"'(\xc2\xab]*([A-Za-z\x80-\xff]+)(?:[-'\x80-\xff][A-Za-z\x80-\xff]+)*([^A-Za-z0-9\x80-\xff]*)")
KEYWORD = re.compile(rb"(?i)pass|pwd|secret|token|api|key|auth|bearer|cred|login|private|kennwort|zugang|contrase|clave|clef")
#: Words that announce something that only looks like a secret.
LABEL = re.compile(
    rb"(?i)\W*(commits?|revision|rev|sha-?\d*|md5|checksum|hash|digest|uuid|guid|id|order|invoice|ticket|version|release|build|model|serial|isbn|doi|tag|image|layer|etag"
    rb"|trace|session|request|blob|file|path|fixes|merge|parcel|flight|plate|part|card|gpu|bestellung|rechnung|karte|commande|facture|pedido|factura)\W*"
)
UUID = re.compile(rb"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
PLACE = re.compile(rb"(^|[\w.~-])/[\w.@+-]+/|\.(so|py|js|ts|png|jpe?g|gif|svg|tar|gz|zip|pdf|dll|exe|jar|csv|json|ya?ml|xml|html?|md|txt|log|cpp|go|rs|whl|deb|iso|mp4)\b", re.IGNORECASE)
TOLD = re.compile(rb"(?i)\W*(sha\d+|md5|data|urn|doi|isbn|uuid|commit|rev|https?|git)\W*[:=/-]")
CODES = re.compile(rb"[A-Z0-9]{1,8}([-_./#][A-Z0-9]{1,10})+")
MODEL = re.compile(rb"[A-Za-z]{1,8}-?\d{1,5}[A-Za-z]{0,4}")
PREFIX = re.compile(rb"[\"'=:]*(AKIA|ghp_|gho_|sk-|sk_|xox[abp]-|eyJ|AIza|glpat-|ya29)")
CORE = re.compile(rb"[A-Za-z0-9+/_=.@!$%^&*~:-]+")
OWN, NEAR, FILE, AROUND = 30, 8, 3, 3
#: Words back to which a keyword, or a label, tells something about an odd word.
KEYWORD_REACH, LABEL_REACH = 8, 4


def base_spans(text: str, kinds: tuple[str, ...] = KINDS[:3]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, in code points; matches that fail a length are dropped."""
    out = []
    if "assign" in kinds:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in kinds:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if "hex" in kinds:
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def shape_class(word: bytes) -> bytes:
    """Words of one class have the same features. Plain prose falls into few classes, other words are their own."""
    m = PROSE.fullmatch(word)
    if m and len(word) <= 24 and not KEYWORD.search(word) and not PREFIX.match(word) and not LABEL.fullmatch(word):
        letters = m[1]
        case = b"l" if letters.islower() else b"U" if letters.isupper() else b"T" if letters[1:].islower() or len(letters) == 1 else b"l" if not letters.isascii() else b"M"
        if case != b"M":
            tail = m[2][:1] if len(set(m[2])) <= 1 else b"?"
            return b"\x00" + case + tail + (b"+" if len(word) > 9 else b"-")
    return word


def own_features(word: bytes) -> np.ndarray:
    """Shape of a word: lengths, character mix, case changes, variety of characters, known prefixes."""
    x = np.zeros(OWN)
    if word[:1] == b"\x00":
        x[[0, {108: 1, 85: 2, 84: 3}[word[1]]]] = 1
        x[4] = word[2:3] in b".,;!?-+" and len(word) > 3
        x[5] = word[2:3] in b"#*$%&|<>" and len(word) > 3
        return x
    core = max(CORE.findall(word) or [b""], key=len)
    n = len(core)
    digits, lower, upper = (sum(a <= c <= b for c in core) for a, b in ((48, 57), (97, 122), (65, 90)))
    kinds = [48 <= c <= 57 for c in core]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    cases = sum((97 <= a <= 122) != (97 <= b <= 122) for a, b in zip(core, core[1:], strict=False) if chr(a).isalpha() and chr(b).isalpha())
    x[6] = 1
    x[7:12] = n <= 5, 6 <= n <= 9, 10 <= n <= 15, 16 <= n <= 31, n >= 32
    x[12] = digits > 0 and lower + upper > 0
    x[13] = digits == n > 0
    x[14] = lower > 0 and upper > 0 and digits > 0
    x[15] = min(1.0, changes / 6)
    x[16] = min(1.0, cases / 5)
    x[17] = len(set(core)) / max(1, n) > 0.5 and n >= 8
    x[18] = bool(PREFIX.match(word))
    x[19] = bool(KEYWORD.search(word)) and n < 24
    x[20] = word[-1:] in b"=:"
    x[21] = any(c in core for c in b"@!$%^&*~") and digits > 0
    x[22] = bool(re.search(rb"(?i)(pass|pwd|secret|token|key)\w*[\"']?[:=]+[\"']?[^\s\"':=]{4,}", word))
    x[23] = bool(re.search(rb"://|@[A-Za-z0-9-]+\.[a-z]|^\W*\d+([.:/,-]\d+)+\W*$|\.(com|org|net|html?)\b", word))
    x[24] = bool(re.fullmatch(rb"[0-9a-f]{7,128}", core)) and digits > 0
    x[25] = bool(UUID.search(word))
    x[26] = bool(PLACE.search(word))
    x[27] = bool(TOLD.match(word))
    x[28] = bool(CODES.fullmatch(core)) and digits > 0
    x[29] = bool(MODEL.fullmatch(core)) and n < 14
    return x


def _key(word: bytes) -> bool:
    return bool(KEYWORD.search(word)) and len(word) < 24


def around_flags(word: bytes) -> tuple[bool, bool, bool]:
    """Whether a word of this class is a keyword, a label, or odd: of letters and digits or signs."""
    if word[:1] == b"\x00":
        return False, False, False
    own = own_features(word)
    return _key(word), bool(LABEL.fullmatch(word)), bool(own[12] or own[14] or own[21])


def around_features(flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each word (rows of ``around_flags``; ``begin`` is where its text begins): an odd word after a keyword, without one, after a label."""
    at = np.arange(len(flags))
    key, label = (np.r_[-1 << 40, np.maximum.accumulate(np.where(flags[:, k], at, -1 << 40))][:-1] for k in (0, 1))
    after_key = (at - key <= KEYWORD_REACH) & (key >= begin)
    after_label = (at - label <= LABEL_REACH) & (label >= begin)
    odd = flags[:, 2].astype(bool)
    return np.stack([odd & after_key, odd & ~after_key, odd & after_label], 1).astype(float)


def near_features(word: bytes | None) -> np.ndarray:
    """What a word tells about its neighbours; None is beyond the text."""
    if word is None:
        return np.array([1, 0, 0, 0, 0, 0, 0, 0], float)
    if word[:1] == b"\x00":
        return np.array([0, 1, 0, 0, 0, 0, 0, 0], float)
    key = _key(word)
    sign = word[-1:] in b"=:"
    return np.array([0, 0, key, sign, key and sign, word in (b"=", b":", b"is", b":=", b"=>"), any(48 <= c <= 57 for c in word), bool(LABEL.fullmatch(word))], float)


def file_features(text: bytes) -> np.ndarray:
    """Density of signs, of digits, and whether lines end as code does."""
    n = max(1, len(text))
    signs = sum(text.count(c) for c in (b"=", b"{", b"}", b";", b"_", b'"'))
    digits = n - len(text.translate(None, b"0123456789"))
    return np.array([min(1.0, 20 * signs / n), min(1.0, 5 * digits / n), float(text.count(b";\n") + text.count(b"{\n") > 1)])


def _training() -> list[tuple[list[bytes], list[int]]]:
    """Generated lines with tags: prose in many shapes, code, contacts and numbers, and secrets of known forms."""
    rng = np.random.default_rng(SEED)
    pick = lambda x: x[int(rng.integers(len(x)))]
    chars = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = "th an er in re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch é ü ñ è".split()

    def prose() -> str:
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 6))))
        r = rng.random()
        if r < 0.12:
            w = w.capitalize()
        elif r < 0.18:
            w = w.upper()
        if rng.random() < 0.2:
            w += pick([".", ",", ";", "!", "?", "!!", "###", "$$$", "***", "%%%", "&&&", ":"])
        return w

    def plain() -> list[str]:
        r = rng.random()
        if r < 0.8:
            return [prose()]
        return [pick([
            chars(num, int(rng.integers(1, 8))), ".".join(chars(num, int(rng.integers(1, 4))) for _ in range(4)), f"{chars(num, 4)}-{chars(num, 2)}-{chars(num, 2)}",
            f"{prose().strip('.,;!?#$*%&:')}{chars(num, 2)}@{chars(low, 5)}.com", f"https://{chars(low, 6)}.org/{chars(low, 4)}/{chars(num, 4)}", f"+{chars(num, 11)}", chars(num, 16),
            f"{chars(low, 4)}_{chars(low, 5)}", f"{chars(low, 3)}({chars(low, 2)})", "=", "|", f"v{chars(num, 1)}.{chars(num, 1)}", f"({chars(num, 3)})", f"{chars(num, 3)}-{chars(num, 3)}-{chars(num, 4)}",
            f"{chars(low, 5)}{chars(num, 1)}", f"{chars(up, 2)}{chars(num, 4)}", "commit", "version", "order", "image", "file", "token", "key", "secret", "password", "tokens", "keys", "keyboard", f"{chars(up, 2)}{chars(num, 20)}", "is", "MIT", "CC", "BY-NC", "4.0.",
        ])]

    def harmless() -> list[str]:
        """What looks like a secret and is none: hashes and names under their label, or bare, also after a keyword that isn't about them."""
        hexed = lambda n: chars("0123456789abcdef", n)
        label = pick(["commit", "Commit", "revision", "sha256", "SHA-1", "md5:", "checksum", "hash", "digest", "uuid", "ID", "id:", "order", "invoice", "ticket", "version", "release", "build", "model", "serial", "tag", "image", "layer", "ETag:", "trace", "request", "file", "path", "fixes", "merge", "card", "Bestellung", "Rechnung", "commande", "pedido"])
        thing = pick([
            lambda: hexed(int(pick([7, 8, 12, 32, 40, 64]))), lambda: "-".join(hexed(k) for k in (8, 4, 4, 4, 12)), lambda: f"{pick(['sha256', 'md5', 'sha1'])}{pick([':', '-', '='])}{hexed(int(pick([32, 40, 64])))}",
            lambda: f"/{pick(['usr', 'opt', 'home', 'var'])}/{chars(low, 5)}/{chars(low, 4)}{chars(num, 2)}/{chars(low, 3)}{chars(low + num, 6)}.{pick(['so', 'so.6', 'py', 'log', 'tar.gz', 'h'])}",
            lambda: f"{chars(low, 6)}-{chars(num, 1)}.{chars(num, 2)}.{chars(num, 1)}{pick(['', '-rc1', '-beta2', '.dev3'])}{pick(['', '.tar.gz', '.whl', '.zip'])}", lambda: f"{chars(up, int(rng.integers(1, 4)))}-{chars(num, 4)}-{chars(up + num, 5)}",
            lambda: f"{chars(num, 8)}-{chars(num, 4)}", lambda: f"{pick([chars(up, 3), chars(low, 3).capitalize()])}{chars(num, 4)}{pick(['', 'Ti', 'X', 'XT', 'b'])}", lambda: "data:image/png;base64," + chars(low + up + num + "+/", int(rng.integers(20, 60))),
            lambda: f"https://{chars(low, 6)}.org/{chars(low, 3)}/{hexed(12)}?{chars(low, 2)}={chars(num, 5)}", lambda: ":".join(hexed(2) for _ in range(6)), lambda: f"10.{chars(num, 4)}/{chars(low, 4)}.{chars(num, 4)}.{chars(num, 3)}",
            lambda: f"{chars(low, 5)}_{chars(low, 4)}_{chars(num, 2)}", lambda: f"{chars(low, 4)}{chars(num, 2)}.{chars(low, 5)}({chars(low, 2)}{chars(num, 1)})", lambda: chars(up, 2) + chars(num, 20), lambda: f"{chars(low, 6)}/{chars(low, 5)}@{hexed(8)}",
            lambda: f"{chars(num, 4)}-{chars(num, 2)}-{chars(num, 2)}T{chars(num, 2)}:{chars(num, 2)}:00Z", lambda: f"x{chars(num, 2)}_{chars(num, 2)}", lambda: f"{chars(low, 7).capitalize()}{chars(low, 5).capitalize()}{chars(num, 1)}", lambda: f"index_{chars(low, 3)}{chars(num, 3)}.{pick(['html', 'js', 'png'])}",
        ])()
        r, end = rng.random(), pick(["", "", ".", ",", ")"])
        if r < 0.5:
            return [label, *([pick(["=", ":", "is", "of"])] if rng.random() < 0.3 else []), thing + end]
        if r < 0.6:
            return [pick(["the", "our", "a"]), pick(["key", "token", "password", "author"]), pick(["of", "in", "from"]), label, thing + end]
        return [thing + end]

    def value() -> str:
        return pick([
            lambda: "AKIA" + chars(up + num, 16), lambda: "ghp_" + chars(low + up + num, 36), lambda: "sk-" + chars(low + up + num, 32), lambda: "eyJ" + chars(low + up + num, 20) + "." + chars(low + up + num + "-_", 30),
            lambda: chars("0123456789abcdef", int(pick([16, 18, 32, 40, 64]))), lambda: chars(low + up + num + "+/", 40), lambda: chars(low + num, int(rng.integers(10, 24))), lambda: chars(low + up + num + "!@$%", int(rng.integers(9, 20))),
            lambda: "AIza" + chars(low + up + num + "_-", 35), lambda: "xoxb-" + chars(num, 11) + "-" + chars(low + up + num, 24),
        ])()

    def secret() -> tuple[list[str], list[int]]:
        key = pick(["password", "passwd", "pwd", "secret", "token", "api_key", "API_KEY", "apikey", "auth_token", "access_key", "Password", "SECRET_KEY", "private_key"])
        v, r, q = value(), rng.random(), pick(["", '"', "'"])
        end = pick(["", "", ".", ";", ","])
        if r < 0.2:
            return [f"{key}={q}{v}{q}{end}"], [B]
        if r < 0.4:
            return [key, pick(["=", ":", "is", ":="]), f"{q}{v}{q}{end}"], [O, O, B]
        if r < 0.6:
            return [f"{key}{pick([':', '='])}", f"{q}{v}{q}{end}"], [O, B]
        if r < 0.7:
            return ["Authorization:", "Bearer", v], [O, O, B]
        if r < 0.74:  # some words stand between
            words = [pick(["the", "der", "le", "el", "our"]), pick(["password", "passphrase", "token", "key", "Passwort", "Kennwort", "passe", "clave", "contraseña", "secret"]), *(prose().strip(".,;!?#$*%&:") or "on" for _ in range(int(rng.integers(1, 5)))), pick(["is", "was", "ist", "lautet", "est", "es", ":"])]
            return [*words, f"{q}{v}{q}{end}"], [O] * len(words) + [B]
        if r < 0.78:
            half = len(v) // 2
            return [f"{key}:", v[:half], v[half:]], [O, B, I]
        if r < 0.86:
            return ["AKIA" + chars(up + num, 16)], [B]
        return [pick(["AKIA" + chars(up + num, 16), "ghp_" + chars(low + up + num, 36), "sk-" + chars(low + up + num, 32)])], [B]

    lines = []
    for _ in range(TRAINING_LINES):
        words, tags = [], []
        for _ in range(int(rng.integers(3, 14))):
            r = rng.random()
            if r < 0.08:
                w, t = secret()
            else:
                w = harmless() if r < 0.2 else plain()
                t = [O] * len(w)
            words += w
            tags += t
        lines.append(([w.encode() for w in words], tags))
    return lines


def design(words: list[bytes], extra: np.ndarray) -> np.ndarray:
    """Feature rows of one line: own, previous, next, file, around."""
    classes = [shape_class(w) for w in words]
    own = np.array([own_features(c) for c in classes])
    near = np.array([near_features(c) for c in [None, *classes, None]])
    around = around_features(np.array([around_flags(c) for c in classes]), np.zeros(len(words), int))
    return np.hstack([own, near[:-2], near[2:], np.tile(extra, (len(words), 1)), around])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(lines: list[tuple[list[bytes], list[int]]], rounds: int = 200, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) of greatest penalised likelihood, by Adam on all lines at once; forward-backward gradients."""
    longest = max(len(w) for w, _ in lines)
    width = OWN + 2 * NEAR + FILE + AROUND
    x, y, mask = np.zeros((len(lines), longest, width)), np.zeros((len(lines), longest), int), np.zeros((len(lines), longest), bool)
    for k, (words, tags) in enumerate(lines):
        x[k, : len(words)], y[k, : len(words)], mask[k, : len(words)] = design(words, file_features(b" ".join(words))), tags, True
    gold = np.eye(3)[y] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.einsum("nta,ntb,nt->ab", np.eye(3)[y[:, :-1]], np.eye(3)[y[:, 1:]], both)
    theta = np.zeros(width * 3 + 9)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, t = theta[: width * 3].reshape(width, 3), theta[width * 3 :].reshape(3, 3)
        e = x @ w
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for i in range(1, longest):
            a[:, i] = np.where(mask[:, i, None], _log_sum(a[:, i - 1, :, None] + t, 1) + e[:, i], a[:, i - 1])
        for i in range(longest - 2, -1, -1):
            b[:, i] = np.where(mask[:, i + 1, None], _log_sum(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), b[:, i + 1])
        z = _log_sum(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        moves = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        g = np.r_[np.einsum("ntf,nta->fa", x, p - gold).ravel(), (np.einsum("ntab,nt->ab", moves, both) - gold_moves).ravel()] / len(lines) + penalty * theta
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[: width * 3].reshape(width, 3), theta[width * 3 :].reshape(3, 3)


WEIGHTS = Path(__file__).with_name("secrets.json")


@lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) as shipped; read on the driver and sent with the tasks."""
    held = json.loads(WEIGHTS.read_text())
    return np.array(held["weights"]), np.array(held["transitions"])


def refit() -> None:
    weights, transitions = fit(_training())
    rows = lambda x: "[\n" + ",\n".join(json.dumps([round(v, 6) for v in row]) for row in x.tolist()) + "\n]"
    WEIGHTS.write_text(f'{{"weights": {rows(weights)},\n"transitions": {rows(transitions)}}}\n')


def viterbi(e: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best path over emissions ``e``, entered by ``start`` and left by ``end``; the lower tag on ties."""
    score, back = e[0] + start, []
    for row in e[1:]:
        moves = score[:, None] + t
        back.append(moves.argmax(axis=0))
        score = moves.max(axis=0) + row
    path = [int((score + end).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


class Tagger:
    """Emission scores by shape class, kept for the words seen; forgets at half a million words."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.w, self.t = weights, transitions
        self.t = transitions.copy()
        self.t[O, I] = -1e3  # nothing is inside without a beginning
        spread = transitions[transitions > -100]
        self.sure = 2 * (spread.max() - spread.min()) + 1e-9
        self.reset()

    def reset(self) -> None:
        self.words: dict[bytes, int] = {}
        self.classes: dict[bytes, int] = {}
        near = near_features(None)
        self.flags = [(False, False, False)]
        self.rows = [np.zeros(3)], [near @ self.w[OWN : OWN + NEAR]], [near @ self.w[OWN + NEAR : OWN + 2 * NEAR]]

    def number(self, word: bytes) -> int:
        c = shape_class(word)
        k = self.classes.get(c)
        if k is None:
            k = self.classes[c] = len(self.rows[0])
            near = near_features(c)
            self.flags.append(around_flags(c))
            for rows, row in zip(self.rows, (own_features(c) @ self.w[:OWN], near @ self.w[OWN : OWN + NEAR], near @ self.w[OWN + NEAR : OWN + 2 * NEAR]), strict=True):
                rows.append(row)
        self.words[word] = k
        return k

    def tag(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each text, (first, last + 1) word numbers of the secrets."""
        if len(self.words) > 500_000:
            self.reset()
        get, number = self.words.get, self.number
        numbers, sizes, files = [0], [], []
        for text in texts:
            own = text.split()
            numbers += [k if (k := get(w)) is not None else number(w) for w in own]
            numbers.append(0)
            sizes.append(len(own))
            files.append(file_features(text))
        n, sizes = np.array(numbers), np.array(sizes)
        own, before, after = (np.array(r) for r in self.rows)
        e = own[n]
        e[1:] += before[n[:-1]]
        e[:-1] += after[n[1:]]
        extra = np.array(files).reshape(-1, FILE) @ self.w[OWN + 2 * NEAR : -AROUND]
        doc = np.repeat(np.arange(len(texts)), sizes + 1)
        e[1:] += extra[doc]
        begins = np.cumsum(np.r_[1, sizes + 1])[:-1]
        e += around_features(np.array(self.flags)[n], np.r_[0, begins[doc]]) @ self.w[-AROUND:]
        open_ = (e[:, O] - e[:, 1:].max(axis=1)) <= self.sure
        ends = np.cumsum(np.r_[1, sizes + 1]) - 1  # the boundaries, whose number is 0
        open_[ends] = False
        at = np.flatnonzero(open_)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(at):
            return out
        first = at[np.r_[True, np.diff(at) > 1]]
        last = at[np.r_[np.diff(at) > 1, True]]
        boundary = np.zeros(len(n), bool)
        boundary[ends] = True
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            enter = np.array([0, 0, -1e3]) if boundary[a - 1] else self.t[O]
            leave = np.zeros(3) if boundary[b + 1] else self.t[:, O]
            path = viterbi(e[a : b + 1], self.t, enter, leave)
            if path.any():
                d = int(doc[a - 1])
                base = int(ends[d]) + 1
                begins = np.flatnonzero(path == B)
                for s in begins.tolist():
                    k = s + 1
                    while k < len(path) and path[k] == I:
                        k += 1
                    out[d].append((a + s - base, a + k - base))
        return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(text: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans of runs of words, quotes and closing marks left off."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    out = []
    for a, b in found:
        s, e = int(starts[a]), int(ends[b - 1])
        part = text[s:e]
        s += len(part) - len(part.lstrip(b"\"'(<["))
        e -= len(part) - len(part.rstrip(b"\"')>],.;"))
        if s < e:
            out.append((int(point[s]), int(point[e])))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base (joined spans), spans (the field's added).

    Spans are kind:start:end in code points, by start, then kind, the field's (crf) last; those of the field are all
    there, also where they overlap fixed ones. A null or empty text has none, an empty table gives no rows. Each row is
    scanned by itself, whole however long, so ids that are null or repeat need no rule. Other columns are not read.
    """
    weights, transitions = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(weights, transitions)
        for batch in slices(batches):
            column = pc.fill_null(batch.column(1), "")
            hints = [pc.match_substring_regex(column, HINTS[k]).to_numpy(zero_copy_only=False) for k in KINDS[:3]]
            rows = []
            for part in blocks(enumerate(text_bytes(column)), 1 << 20):
                for (i, text), found in zip(part, tagger.tag([t for _, t in part]), strict=True):
                    kinds = tuple(k for k, h in zip(KINDS, hints, strict=False) if h[i])
                    base = base_spans(text.decode(), kinds) if kinds else []
                    extra = [(s, "crf", e) for s, e in word_spans(text, found)] if found else []
                    rows.append((*(sum(k == x[1] for x in base) for k in KINDS[:3]), joined(base), joined(base + extra)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op2_secrets": op2_secrets}
SQL: dict[str, str] = {}


if __name__ == "__main__":
    refit()
