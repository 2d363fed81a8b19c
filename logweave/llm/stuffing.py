"""Problem 9: keyword-stuffed pages and link lists, by perplexity under a model of prose.

Text becomes a sequence of word classes (function word, lower-case word, name,
number, link, tag, code, punctuation, line break ...).  A trigram model of the
classes is trained on the prose paragraphs of the whole corpus: exact counts,
summed on the map side, and never more than ``len(CLASSES) ** 3`` rows, which
is the proven bound of what the driver receives and sends back.  Each token of
a document then has a perplexity over its neighbourhood; where that is far
above or far below that of prose, the characters stand in no sentences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.mail import own_body
from logweave.session import materialised

# Function words of the languages of the corpus (articles, pronouns, prepositions, conjunctions, auxiliaries).
FUNCTION_WORDS = {
    "en": "a about after all also although am an and any are as at be because been before both but by can could did do does each for from had has have he her here his how i if in into is it its just last let like may me more most must my no nor not now of off on once one or other our out over own per please she should since so some such than that the their them then there these they this those through to too under until up us very was we were what when where which while who whom whose why will with without would you your".split(),
    "de": "aber alle als also am an auch auf aus bei beim bin bis bitte das dass dem den der des die doch durch ein eine einem einen einer eines er es für habe haben hat hatte ich ihm ihn ihnen ihr ihre im in ins ist ja kann kein keine man mehr mein meine mit nach nicht noch nur ob oder ohne schon sehr sein seine sich sie sind so über um und uns unser unter vom von vor war waren was weil wenn wer werden wie wir wird zu zum zur".split(),
    "es": "a al algo ante antes aunque como con cuando de del desde después donde el ella ellos en entre era es esta este esto está fue ha hay hasta la las le les lo los me mi mientras muy más nadie ni no nos o para pero por porque que quien se si sin sobre son su sus también tan te tiene todo todos tras tu un una uno unos y ya yo".split(),
    "fr": "a à afin ai après au aux avant avec avoir car ce ceci cela ces cet cette chez comme dans de des donc dont du elle elles en est et été être eu il ils je la le les leur leurs lui l'on ma mais me mes moi mon même ne ni nos notre nous on ont ou où par pendant personne plus pour pourquoi qu que qui quoi sa sans se selon ses si son sont sous sur ta te tes toi ton tous tout très tu un une vos votre vous y".split(),
}
_FUNCTION = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)

#: Symbols of the classes, in the order of their numbers.
CLASSES = "^npfwCAWdUHEKPb,.:;qo"
_CODE = {c: i for i, c in enumerate(CLASSES)}
V = len(CLASSES)

#: Content words in a row, line breaks between them or not, from which on a lower-case word is one of a long string (class W).
LONG_STRING = 5
_CONTENT = np.isin(np.arange(V), [_CODE[c] for c in "wCAdKP"])
_RESET = ~_CONTENT & (np.arange(V) != _CODE["n"])


def _mark_strings(seq: np.ndarray) -> np.ndarray:
    """Lower-case words deep inside a string of content words get a class of their own: a trigram alone cannot see so far."""
    count = np.cumsum(_CONTENT[seq])
    since = count - np.maximum.accumulate(np.where(_RESET[seq], count, 0))
    return np.where((seq == _CODE["w"]) & (since >= LONG_STRING), _CODE["W"], seq)


_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_EMAIL = re.compile(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+$")
_LEAD = re.compile(r"[^\w#$€£%+\-]*")
_TRAIL = re.compile(r"[^\w%€$£+]")
_PRICE = re.compile(r"^(?:[A-Z]{3}|[$€£+\-])?\d[\d.,]*(?:%|€|\$|£|EUR|USD|GBP)?$")


#: Words of at most so many letters count as function words of whatever language, as most of them are.
SHORT = 2


def _function(word: str) -> bool:
    low = word.lower().replace("’", "'")
    head = low.split("'")[0] if "'" in low else low
    return low in _FUNCTION or head in _FUNCTION or ("'" in low and len(head) <= 2) or (len(low) <= SHORT and low.isalpha() and not (word.isupper() and len(word) > 1))


def _classes(token: str) -> bytes:
    """Class numbers of one token, its punctuation included."""
    out: list[str] = []
    if len(token) <= 4 and re.fullmatch(r"[*\-+•·–—>|#=~_]+|\d{1,3}[.)]", token):
        return bytes([_CODE["b"]])
    m = _URL.search(token)
    if m:
        if m.start():
            out.append("q")
        out.append("U")
        if token[-1] in ",;":
            out.append(token[-1])
        return bytes(_CODE[c] for c in out)
    a, z = _LEAD.match(token).end(), len(token)
    while z > a and _TRAIL.match(token[z - 1]):
        z -= 1
    core, trail = token[a:z], token[z:]
    if a:
        out.append("q")
    if core:
        if core[0] == "#" and len(core) > 1:
            out.append("H")
        elif "@" in core and _EMAIL.fullmatch(core):
            out.append("E")
        elif any(ch.isdigit() for ch in core):
            plain = core.lstrip("+-").replace(".", "").replace(",", "").replace(":", "").replace("/", "").replace("-", "")
            out.append("d" if plain.isdigit() else "P" if _PRICE.match(core) else "K")
        elif _function(core):
            out.append("f")
        elif core.isupper() and len(core) > 1:
            out.append("A")
        elif core[0].isupper():
            out.append("C")
        elif core[0].isalpha():
            out.append("w")
        else:
            out.append("o")
    for ch in trail[:2]:
        out.append("." if ch in ".!?…" else ch if ch in ",:;" else "q")
    return bytes(_CODE[c] for c in out or ["o"])


_remembered = lru_cache(maxsize=1 << 18)(_classes)


def classes_of(token: str) -> bytes:
    """The same; tokens that are no longer than words are remembered."""
    return _remembered(token) if len(token) <= 64 else _classes(token)


#: Punctuation between letters also parts tokens: keywords are often strung together without blanks.
_INNER = re.compile(r"(?<=[^\W\d_])([,;|])(?=[^\W\d_])")
_QUOTED = re.compile(r"^\s{0,2}[>|]")
_ATTRIBUTION = re.compile(r":\s*$")
_ORIGINAL = re.compile(r"^\s*(?:-{3,}\s*\w[^\n]*\w\s*-{3,}\s*$|_{8,}\s*$|(?:>\s*)?(?:From|Von|De|Expéditeur)\s*:\s)")
_DIGEST = re.compile(r"^\s*-{3}\s*message \d+\s*-{3}\s*$", re.I)


_PARAGRAPH, _LINE_END = bytes([_CODE["p"]]), bytes([_CODE["n"]])


def sequence(body: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class numbers, characters that each stands for, whether it is quoted mail) of a readable body.

    Quoted mail: lines with quote marks after an attribution line, and all that
    follows a header block of an original message.
    """
    codes: list[bytes] = []
    lengths: list[int] = []  # of tokens; 0 for line ends
    spans: list[tuple[int, bool]] = []  # tokens of a line, whether it is quoted
    inside = below = False
    previous = ""
    for line in _INNER.sub(r"\1 ", body).split("\n"):
        tokens = line.split()
        if not tokens:
            codes.append(_PARAGRAPH)
            lengths.append(0)
            spans.append((1, inside or below))
            continue
        if _QUOTED.match(line):
            inside = inside or bool(_ATTRIBUTION.search(previous))
        else:
            inside = False
            if not below and _ORIGINAL.match(line) and not _DIGEST.match(line):
                below = True
        codes.extend(map(_remembered if len(line) < 256 else classes_of, tokens))
        codes.append(_LINE_END)
        lengths.extend(map(len, tokens))
        lengths.append(0)
        spans.append((len(tokens) + 1, inside or below))
        previous = line
    symbols = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
    chars = np.zeros(int(symbols.sum()), dtype=np.int64)
    chars[np.cumsum(symbols) - symbols] = lengths
    n, quoted = np.array([x for x, _ in spans]), np.array([x for _, x in spans], dtype=bool)
    seq = np.frombuffer(b"".join(codes), dtype=np.uint8).astype(np.int64)
    return _mark_strings(seq), chars, np.repeat(np.repeat(quoted, n), symbols)


_TABLE = np.zeros((4, V), dtype=np.int64)
for _row, _symbols in enumerate(("fwCAW", ",;b", ".", "UHKP")):  # words, separators, sentence ends, links and tags
    _TABLE[_row, [_CODE[c] for c in _symbols]] = 1


def _learnable(seq: np.ndarray) -> np.ndarray | None:
    """The paragraphs without links and tags of a text that is mostly prose; None of others.

    Prose is told by its punctuation, in any language: paragraphs of at least
    eight words whose sentences have three to forty words, with at most one
    separator to four words.
    """
    starts = np.unique(np.concatenate(([0], np.flatnonzero(seq == _CODE["p"]))))
    words, separators, ends, links = np.add.reduceat(_TABLE[:, seq], starts, axis=1)
    prose = (words >= 8) & (words >= 3 * ends) & (words <= 40 * ends) & (4 * separators <= words) & (links == 0)
    if not words.sum() or words[prose].sum() < TRAIN_SHARE * words.sum():
        return None
    return seq[np.repeat(links == 0, np.diff(np.append(starts, len(seq))))]


#: Share of the words in prose paragraphs from which the model learns from a text: its greetings and signatures belong to prose.
TRAIN_SHARE = 0.4
_PAD = np.zeros(2, dtype=np.int64)

#: A document as the model reads it: a byte per symbol, its characters in one byte each or in eight where one is longer, a bit for quoted mail.
SEQUENCES = "doc_id long, symbols binary, chars binary, quoted binary"


def _packed(body: str) -> tuple[bytes, bytes, bytes]:
    seq, chars, quoted = sequence(body)
    small = not len(chars) or chars.max() < 256
    return seq.astype(np.uint8).tobytes(), chars.astype(np.uint8 if small else np.int64).tobytes(), np.packbits(quoted).tobytes()


def _unpacked(symbols: bytes, chars: bytes, quoted: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seq = np.frombuffer(symbols, dtype=np.uint8).astype(np.int64)
    kind = np.uint8 if len(chars) == len(seq) else np.int64
    return seq, np.frombuffer(chars, dtype=kind).astype(np.int64), np.unpackbits(np.frombuffer(quoted, dtype=np.uint8), count=len(seq)).astype(bool)


def sequences(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text: raw messages) decoded and classed once, as :data:`SEQUENCES`; a null text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_packed(own_body(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{c: [x[i] for x in got] for i, c in enumerate(("symbols", "chars", "quoted"))}})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SEQUENCES)


def trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of the sequences of a partition that are mostly prose, as one table; paragraphs with links or tags are passed over."""
    counts = np.zeros(V**3, dtype=np.int64)
    for pdf in batches:
        seqs: list[np.ndarray] = []
        for symbols in pdf["symbols"]:
            seq = np.frombuffer(symbols, dtype=np.uint8).astype(np.int64)
            kept = _learnable(seq) if len(seq) else None
            if kept is not None:
                seqs.extend((_PAD, kept))
        if seqs:
            all_ = np.concatenate(seqs)
            tri = all_[:-2] * V * V + all_[1:-1] * V + all_[2:]
            counts += np.bincount(tri[all_[2:] != 0], minlength=V**3)  # no trigram ends in the padding
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"trigram": at, "n": counts[at]})


class ProseModel:
    """Interpolated trigram model; ``cost[t]`` is the surprise of a trigram in bits."""

    def __init__(self, counts: dict[int, int]):
        c3 = np.zeros(V**3)
        for t, n in counts.items():
            c3[t] = n
        c3 = c3.reshape(V, V, V)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        share = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1)
        p = 0.6 * share(c3) + 0.3 * share(c2)[None] + 0.08 * share(c1)[None, None] + 0.02 / V
        self.cost = -np.log2(p).ravel()
        total = max(1.0, c3.sum())
        w = c3.ravel() / total
        self.mean = float((w * self.cost).sum()) if c3.sum() else math.log2(V)
        self.sd = float(np.sqrt((w * (self.cost - self.mean) ** 2).sum())) if c3.sum() else 1.0


#: Tokens of the neighbourhoods over which a perplexity is taken: wide for strings of words, narrow for lists of long links.
WINDOWS = (24, 8)
#: Standard errors from the mean of prose beyond which a neighbourhood is abnormally high, or abnormally low.
HIGH, LOW = 3.5, 2.5
#: Share of function words among the words of a neighbourhood from which it is read as sentences, however odd its order (links, lists and names stand between them).
FUNCTION_SHARE = 0.12
#: Share of the characters above which a document is one of these pages.
SHARE = 0.5


def stuffed_share(model: ProseModel, body: str, windows: tuple[int, ...] = WINDOWS, high: float = HIGH, low: float = LOW) -> tuple[float, float]:
    """(share of non-blank characters outside sentences, perplexity of the whole) of a body; (0, 0) of an empty one."""
    return _scores(model, *sequence(body), windows, high, low)


def _scores(model: ProseModel, seq: np.ndarray, chars: np.ndarray, quoted: np.ndarray, windows: tuple[int, ...] = WINDOWS, high: float = HIGH, low: float = LOW) -> tuple[float, float]:
    total = int(chars.sum())
    if not total:
        return 0.0, 0.0
    s = np.concatenate(([0, 0], seq))
    cost = model.cost[s[:-2] * V * V + s[1:-1] * V + s[2:]]
    own = ~quoted
    cost_own, chars_own = cost[own], chars[own]
    n = len(cost_own)
    if not n:
        return 0.0, 0.0
    kind = s[2:][own]
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (cost_own, (kind >= _CODE["f"]) & (kind <= _CODE["W"]), kind == _CODE["f"])]
    at, odd = np.arange(n), np.zeros(n, dtype=bool)
    for w in windows:
        a, z = np.maximum(0, at - w // 2), np.minimum(n, at + w // 2 + 1)
        cost_in, words_in, function_in = (x[z] - x[a] for x in sums)
        mean, error = cost_in / (z - a), model.sd / np.sqrt(z - a)
        sentences = function_in >= FUNCTION_SHARE * np.maximum(1, words_in)
        odd |= ((mean > model.mean + high * error) | (mean < model.mean - low * error)) & ~sentences
    return float(chars_own[odd].sum() / total), float(2 ** (cost_own.mean()))


def train(read: DataFrame) -> ProseModel:
    """The model of all documents, given as sequences: at most ``len(CLASSES) ** 3`` counts reach the driver."""
    counts = read.select("symbols").mapInPandas(trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    return ProseModel({r.trigram: r.n for r in counts.toLocalIterator()})


def stuffing_scores(documents: DataFrame, model: ProseModel | None = None) -> DataFrame:
    """(doc_id, stuffed_share, perplexity) of each document (doc_id, text: raw messages); null and empty texts score 0, rows without doc_id only train.

    The sequences are written once to the shared checkpoint folder: training
    and scoring read them from there, so no text is decoded twice.
    """
    read = sequences(documents)
    if model is None:
        read = materialised(read)
        model = train(read)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_scores(model, *_unpacked(*x)) for x in zip(pdf["symbols"], pdf["chars"], pdf["quoted"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "stuffed_share": [x for x, _ in got], "perplexity": [y for _, y in got]})

    return read.where("doc_id is not null").mapInPandas(run, "doc_id long, stuffed_share double, perplexity double")


def stuffed_pages(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents of which more than ``share`` of the own readable characters stand in no sentences; one row per doc_id."""
    return stuffing_scores(documents).where(F.col("stuffed_share") > share).select("doc_id").distinct()
