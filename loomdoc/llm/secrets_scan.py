"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two order-1 character models, of random strings and of ordinary identifiers,
are trained from labelled samples.  Candidates are the
runs of CANDIDATE characters, at least LEAST_CANDIDATE of them; any other character ends one, so the
parts of a dotted token are scored one by one.  Of a run that a span found by a pattern covers in
part, each stretch left over is a candidate of its own.

A run falls into parts at `/`, `=`, `_`, `-` and `+`, as paths, assignments and identifiers do.  A stretch of neighbouring parts is a span of kind `random` if
it has LEAST_CANDIDATE characters or more and their log-likelihood ratios are THRESHOLD or more on average.  Of a run the stretch with the largest sum goes first, then
those of what is left on either side: a key in a path or behind an identifier is found without these, and a key that has such signs stays in one piece.

Shorter stretches are not scored, as a ratio over so few characters tells little.  Universally unique ids in their usual form (8-4-4-4-12
hexadecimal digits) are names of things, not secrets, and no spans; written without dashes they are base spans.

Defined results: a null text is empty; positions are code points, ends are
exclusive; equal texts get equal results; an empty table gives no rows; `redact` keeps the columns of docs whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

# The kinds of base spans, in the order used for ties, and their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: A text without any of these, in lower case, has no assign span.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
#: The least length of the random strings that the models learn from.
LEAST_CANDIDATE = 16
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE},}}")
#: Where a run falls into parts: each of these signs is a part of its own.
PART = re.compile(r"[A-Za-z0-9]+|[+/_=-]")

CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
THRESHOLD = 0.35


class CharacterModels:
    """Log-likelihood ratio of random strings against identifiers, by first-order transitions."""

    def __init__(self, samples: Iterable[tuple[str, int]], smoothing: float = 0.5):
        n = len(CLASSES) + 1
        counts = np.full((2, n, n), smoothing)
        for text, label in samples:
            code = self.codes(text)
            np.add.at(counts[int(label)], (code[:-1], code[1:]), 1)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]

    @staticmethod
    def codes(text: str) -> np.ndarray:
        """0 stands for the start and for any other character."""
        return np.array([0, *(CLASSES.find(c) + 1 for c in text)])

    def sums(self, text: str) -> np.ndarray:
        """Sums of the log-likelihood ratios of the first 0, 1, 2, ... characters."""
        code = self.codes(text)
        return np.concatenate([[0.0], np.cumsum(self.ratio[code[:-1], code[1:]])])

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio per character; above 0 the string looks random."""
        code = self.codes(text)
        return float(self.ratio[code[:-1], code[1:]].mean()) if len(code) > 1 else 0.0


# Stems of ordinary identifiers, the negative sample.
STEMS = (
    "account action address array average batch block board buffer button cache center change channel client cluster code color column command "
    "config content context control count create current customer data date default delete detail device directory document domain download edge "
    "element email enable engine entry error event example export factory feature field file filter folder format frame function global graph group "
    "handler header height history host image import index info input install instance integer internal item job key label language large layer "
    "length level library limit line link list load local location lock log login long machine main manager map match memory message method model "
    "module monitor name network node number object offset option order output package page panel parameter parent parser partition path pattern "
    "payment permission phone picture point policy position power print process product profile project property protocol query queue random range "
    "rate read record reference region register release remote report request reset resource response result return role root route row rule sample "
    "schedule schema screen script search section segment select sender server service session setting shape share shell signal simple single size "
    "source space stack standard start state static status storage stream string style summary support switch symbol system table target task "
    "template test text thread time title total track transaction transform tree trigger type update upload user validate value variable vector "
    "version video view virtual visitor volume warning watch width window worker write zone"
).split()

# Stems of long words of prose, by language; compounds of them are negative samples too.
PROSE = (
    "able about after again against another because before between beyond business certain children company complete consider country develop "
    "different during every example family follow general government great hand hood house important interest itself knowledge least less light little "
    "mother nation nature never night other over people perhaps place point power present problem question reason right school should something "
    "state strong that their there these they thing think this thought through together tion under water weather whether which while whole without "
    "woman wonder work world would write year young ance ence ful ism ment ness ship ward wise".split(),
    "abend anfang arbeit auch aufgabe bedeutung beispiel bereich besonders betrieb bild bitte buch burg dampf deutsch dienst ding einheit ende entwicklung "
    "erde erfahrung ergebnis ernst fahrt familie farbe fenster fest fisch flug folge forschung frage freiheit freund ganz geben gebiet gefahr gegen "
    "geist geschichte gesellschaft gesetz gesicht gewalt glauben gleich grund gruppe hand haupt haus herz himmel hoch jahr kampf keit kind kirche kopf kraft "
    "krankheit kunst land leben lich macht mensch milch mittel moment mutter nacht name natur pflanze pflicht platz politik pferd recht regel reise sache schaft schiff "
    "schlag schloss schrift schule schutz schwester seite sinn sprache staat stadt stimme strasse stunde tag teil tisch ung verhalten versicherung volk wagen wahrheit "
    "wasser weg welt werk wert wirtschaft wissen wohnung zahl zeit zeitung ziel zimmer zug zwischen".split(),
    "alors amour ancien apparence aujourd aussi autre avant avec beau beaucoup besoin bois bonheur bouche bras cause chambre chaque chemin cheval chose ciel "
    "coeur comme compte corps couleur coup cour dans depuis dernier deux doute eau effet encore enfant esprit eux exemple faire famille femme feu feuille "
    "fleur fois force genre gens gouvernement grand guerre heure heureux histoire homme honneur idee jeu jeune jour lettre lieu lumiere main maison maitre "
    "matin mieux moment monde mort moyen nature nombre nouveau nuit oeil oiseau ombre ordre oublier parole partie passage pays peau peine pensee personne "
    "petit peuple pied place plaisir pouvoir premier propos quatre question quelque raison regard reste rien route saison sang sens silence soleil sorte "
    "souvenir temps terre tete toujours tout travail travers trois trouver verite vieux ville visage voix vouloir ement eux ique tion".split(),
    "agua ahora alguien alma amigo amor antes aqui bajo bastante bien blanco boca bueno cabeza cada calle camino campo cara casa causa cielo ciudad claro "
    "conocimiento corazon cosa cuando cuenta cuerpo deseo despues dia dinero donde edad ejemplo encima entonces entre escuela espejo espiritu estado estrella "
    "fuerza gente gobierno grande guerra hacer hacia hermano hija historia hombre hora idea iglesia justo lado lengua libro llegar lugar luz madre manera mano "
    "mayor mejor memoria mesa miedo mientras momento muerte mujer mundo nada negro ninguno noche nombre nuestro nuevo nunca ojos padre palabra paso pensamiento "
    "pequeno pero persona piedra poder porque primero problema pueblo puerta quien razon sangre segundo senor siempre siglo sobre sol suelo tarde tiempo tierra "
    "todo trabajo verdad viaje vida viejo viento vista cion dad mente miento".split(),
)


def labelled_samples(n: int = 4000, seed: int = 17) -> list[tuple[str, int]]:
    """n random strings (label 1) over common secret alphabets, n identifiers and long words (label 0) joined from stems, and n // 2 rules, sequences and paths (label 0)."""
    draw = random.Random(seed)
    lower, upper, digits = CLASSES[:26], CLASSES[26:52], CLASSES[52:62]
    alphabets = [lower + upper + digits, lower + upper, lower + upper + digits + "+/", lower + upper + digits + "_-", lower + digits, upper + digits, digits + "abcdef"]
    out = [("".join(draw.choices(draw.choice(alphabets), k=draw.randint(LEAST_CANDIDATE, 48))), 1) for _ in range(n)]
    for _ in range(n):
        parts = draw.choices(STEMS, k=draw.randint(2, 5))
        kind = draw.randrange(8)
        if kind == 0:
            text = "_".join(parts)
        elif kind == 1:
            text = parts[0] + "".join(x.title() for x in parts[1:])
        elif kind == 2:
            text = "-".join(parts)
        elif kind == 3:
            text = "_".join(parts).upper()
        elif kind == 4:
            text = "/".join(parts)
        else:
            text = "".join(draw.choices(draw.choice(PROSE), k=draw.randint(2, 6)))
            text = text if kind == 5 else text.capitalize() if kind == 6 else text.upper()
        out.append((text + (str(draw.randint(1, 2030)) if draw.random() < 0.2 else ""), 0))
    # Rules of one or two signs, alphabets and numbers in order, assignments of paths with short names: regular, though no identifier has them.
    for k in range(n // 2):
        if k % 3 == 2:
            parts = [draw.choice([draw.choice(lower), draw.choice(STEMS), draw.choice(upper)]) for _ in range(draw.randint(3, 12))]
            text = draw.choice(STEMS) + draw.choice(["=", "=/", "/", "_=", "-"]) + draw.choice(["/", "/", "-", "_"]).join(parts) + draw.choice(["", "/"])
        elif k % 3:
            text = "".join(draw.choices(CLASSES, k=draw.choice([1, 1, 1, 2]))) * 48
        else:
            text = draw.choice([lower, upper, digits, lower + upper + digits, "qwertyuiopasdfghjklzxcvbnm", "qwertyuiopasdfghjklzxcvbnm".upper()]) * 2
        out.append((text[: draw.randint(LEAST_CANDIDATE, 48)], 0))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of pattern matches, leftmost and non-overlapping within a kind, sorted."""
    out = []
    folded = text.lower()
    if any(x in folded for x in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A match of HEX is a maximal run, so the runs of 16 and more are the matches that are kept.
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def stretches(text: str, models: CharacterModels, threshold: float) -> list[tuple[int, int]]:
    """The random stretches of a run, in order: the one whose ratios exceed half the threshold most in sum, then those beside it."""
    at = [0, *(m.end() for m in PART.finditer(text))]
    ratios = models.sums(text)[at]
    sums = ratios - (threshold / 2) * np.array(at)
    out, waiting = [], [(0, len(at) - 1)]
    while waiting:
        low, high = waiting.pop()
        if at[high] - at[low] < LEAST_CANDIDATE:
            continue
        # The best stretch with enough characters: for each end the least sum before a start that is far enough.
        best, first, least, i = None, low, low, low
        for j in range(low + 1, high + 1):
            while i < j and at[j] - at[i] >= LEAST_CANDIDATE:
                if i == low or sums[i] < sums[least]:
                    least = i
                i += 1
            if i > low and (best is None or sums[j] - sums[least] >= best[0]):
                best = (sums[j] - sums[least], least, j)
        if best is None:
            continue
        _, first, last = best
        piece = text[at[first] : at[last]]
        if ratios[last] - ratios[first] >= threshold * len(piece):
            if not UUID.fullmatch(piece.strip("+/_=-")):
                out.append((at[first], at[last]))
            waiting += [(low, first), (last, high)]
    return sorted(out)


def model_spans(text: str, models: CharacterModels, base: list[tuple[int, int, int]], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Random stretches of candidates, or of what base spans leave of them."""
    out, at = [], 0
    for start, _, end in [*base, (len(text), 0, len(text))]:
        if start - at >= LEAST_CANDIDATE:
            for m in CANDIDATE.finditer(text, at, start):
                out += [(m.start() + s, m.start() + e) for s, e in stretches(m[0], models, threshold)]
        at = max(at, end)
    return out


def spans_of(text: str, models: CharacterModels, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by start, then kind."""
    base = base_spans(text)
    every = [*base, *((s, len(KINDS), e) for s, e in model_spans(text, models, base, threshold))]
    return [((*KINDS, "random")[k], s, e) for s, k, e in sorted(every)]


def scan(docs: DataFrame, threshold: float = THRESHOLD, samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """doc_id with its spans as an array of (kind, start, end)."""
    sent = shared.Sent(docs.sparkSession, CharacterModels(labelled_samples() if samples is None else samples))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent()
        for batch in batches:
            texts = batch.column("text")
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans_of(t.as_py() or "", models, threshold)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=kind)], ["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, mark: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of the text replaced by mark; other columns stay."""
    sent = shared.Sent(docs.sparkSession, CharacterModels(labelled_samples()))
    docs, back = shared.plain(docs, "text")
    at = docs.columns.index("text")

    def clean(text: str | None, models: CharacterModels) -> str | None:
        if text is None:
            return None
        out, last = [], 0
        for _, start, end in spans_of(text, models, threshold):
            if start >= last:
                out += [text[last:start], mark]
            last = max(last, end)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent()
        for batch in batches:
            yield batch.set_column(at, "text", pa.array([clean(x.as_py(), models) for x in batch.column(at)], type=pa.string()))

    return back(docs.mapInArrow(run, docs.schema))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, the hash of the base spans, and all spans as text."""
    from pyspark.sql import functions as F

    found = scan(docs)
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x.kind != "random")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
