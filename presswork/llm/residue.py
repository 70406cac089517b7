"""Pages that hold a template, server or script message in place of an article (problem 7).

1. Trusted labels: lines in which a page speaks of its own failure, demands scripts or a check,
   or is filler, outnumbering the article around them; and texts with unfilled places of a
   template outside of quotations.
2. The main text of every page, with names, figures, addresses and its own title masked, gets a
   SimHash of 1,024 bits over its distinct five-word shingles. At an agreement of 0.8 a bit
   differs with probability arccos(0.889) / pi = 0.151, so a table of 16 bits finds such a pair
   with 0.07 and 128 tables miss one pair in ten thousand. Of the pairs that meet, those within
   Hamming distance 40 on the first 128 bits (19 +- 4 expected) have their shingle sets compared,
   which must agree to 0.8.
3. Labels of whole-page residue spread along these links until nothing new is reached, so that
   they cover connected components. Unfilled places do not spread: the same text without them
   is an article.

Equal masked texts are one node, so copies cost nothing. Defined cases: null, blank and empty
texts are no residue; rows delivered twice count once; empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from presswork.llm import pages
from presswork.session import stash

SHINGLE, SIMILAR, DISTANCE = 5, 0.8, 40
WORDS, TABLES = 16, 128  # of 64 bits in a code; of 16 bits each
CLEAN, RESIDUE, UNFILLED = 0, 1, 2

_MESSAGES = [
    # demands for scripts
    r"(?:enable|turn on|switch on|activate|allow|requires?|needs?)\b.{0,30}\b(?:javascript|scripts?|scripting|js)\b",
    r"\b(?:javascript|scripts?|scripting|js|cookies)\b.{0,25}\b(?:disabled|switched off|turned off|blocked|deactivated|required)",
    r"without (?:js|javascript|scripts)|(?:unsupported|outdated) browser|browser.{0,20}not supported|upgrade your browser",
    r"ohne (?:skripte?|javascript|js)\b|(?:javascript|skripte?|cookies)\b.{0,30}(?:aktivieren|einschalten|deaktiviert|blockiert|erforderlich)|(?:aktivieren|schalten) sie .{0,30}(?:javascript|skripte?)",
    r"activer? (?:javascript|les scripts)|scripts? (?:sont )?(?:bloqués|désactivés)|sans (?:javascript|scripts?)|ne peut pas s['’]afficher",
    r"acti(?:ve|va|var) (?:javascript|los scripts|los guiones)|sin (?:javascript|scripts?|guiones)|(?:javascript|scripts|guiones) .{0,20}(?:desactivad|bloquead)",
    # demands for a check
    r"(?:confirm|verify|prove|check).{0,20}\byou(?:'re| are).{0,12}(?:person|human|robot|bot)|not a robot|checking your browser|captcha|tick the box|unusual traffic",
    r"bestätigen sie.{0,40}(?:mensch|roboter)|kein roboter|(?:vérifi|confirm)\w+ que vous (?:êtes|n['’]êtes)|pas un robot|(?:confirme|verifique) que (?:es|no es|usted)|no soy un robot",
    # messages of servers
    r"access (?:denied|forbidden)|permission to view|\b(?:401|403|404|410|429|500|502|503|504)\b.{0,3}(?:[–—:-]|error|bad gateway|not found|forbidden|service|gateway|internal)|error \d{3}\b",
    r"(?:page|article|file|address|url)\b.{0,140}(?:not found|not be found|does not exist|no longer (?:exists|available)|been (?:moved|removed|deleted))|we looked for\b.{0,160}did(?: not|n['’]t) find",
    r"internal server error|bad gateway|(?:service|site|page) (?:is )?(?:temporarily )?unavailable|gateway time-?out|\brequest\b.{0,120}timed out|database (?:connection )?error|too many requests|server (?:has gone away|error)|something went wrong|try again (?:later|in a (?:few|moment))|(?:down|closed) for maintenance|under maintenance|slow down and come back",
    r"fehler \d{3}|seite\b.{0,140}nicht gefunden|zugriff\b.{0,140}verweigert|(?:dienst|seite|server)\b.{0,60}nicht (?:erreichbar|verfügbar)|wartungsarbeiten|zu viele anfragen|interner serverfehler",
    r"erreur \d{3}|page\b.{0,140}introuvable|accès (?:refusé|interdit)|(?:momentanément|temporairement) indisponible|trop de requêtes|en maintenance|erreur interne",
    r"error \d{3}|no se (?:encuentra|encontró|ha encontrado)\b.{0,20}página|página\b.{0,140}no (?:encontrada|existe)|acceso (?:denegado|prohibido)|(?:servicio|página)\b.{0,20}no disponible|demasiadas (?:solicitudes|peticiones)|en mantenimiento|error interno",
    # filler
    r"dummy text|placeholder text|sample text|(?:text|copy)\b.{0,90}goes here|to be replaced before|\[(?:insert|add|your) [^\]]{2,80}\]|your (?:text|title|headline) here|this is a test (?:page|post|article)",
    r"\btk\b(?:.*\btk\b){2}|blindtext|platzhaltertext|beispieltext|hier steht.{0,20}text|texte? (?:factice|provisoire|de remplissage)|faux texte|texto (?:de relleno|provisional|de prueba)",
]
#: Cheap necessary condition of a message: one of these substrings.
_KEYS = (
    "script", " js", "browser", "skript", "guion", "cookie", "robot", "captcha", "tick the box", "you are", "you're", "unusual", "mensch", "que vous", "verifique", "confirme",
    "denied", "forbidden", "permission", "not found", "not be found", "not exist", "no longer", "been moved", "been removed", "been deleted", "moved or", "we looked for", "server", "gateway", "unavailable",
    "timed out", "error", "too many", "went wrong", "try again", "maintenance", "slow down", "401", "403", "404", "410", "429", "500", "502", "503", "504", "fehler", "nicht gefunden", "nicht erreichbar", "nicht verfügbar", "verweigert", "wartungs",
    "anfragen", "erreur", "introuvable", "refusé", "interdit", "indisponible", "requêtes", "afficher", "activ", "no se enc", "no se ha enc", "encontrada", "no existe", "denegado", "prohibido", "disponible", "demasiadas", "mantenimiento",
    "dummy", "placeholder", "sample text", "goes here", "text here", "title here", "headline here", "replaced before", "[insert", "[add", "[your", "this is a test", "tk ", "blindtext", "platzhalter", "beispieltext", "hier steht", "texte", "texto",
)
_LATIN_KEYS = ("ipsum", "dolor", "consectetur", "magna", "cillum", "veniam", "ullamco", "pariatur", "laboris")
_MESSAGE = re.compile("|".join(f"(?:{m})" for m in _MESSAGES))
# Words of the customary Latin filler.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim est laborum mattis rutrum pulvinar vestibulum".split()
)
_UNFILLED = re.compile(
    r"\{\{\s*[\w.]+\s*\}\}|\{%\s*[\w. ]+\s*%\}|[$#]\{[\w.]+\}|%%\w+%%|%\(\w+\)[sd]|\b__[A-Z_]+__\b|<%=?\s*[\w.]+\s*%>|\[\[\w+\]\]|\{\d\}|\$\$\w+\$\$|@@\w+@@|\[object Object\]|(?<!\w)\[(?!SIC\])[A-Z][A-Z_ ]{2,24}\](?!\w)|%[A-Z][A-Z_]{2,}%"
    r"|\[(?i:insert|add|your) [^\]\n]{2,80}\]|\bTK\b[^\n]{0,80}\bTK\b"
)
_BEGIN = re.compile(r"[{$#%<\[@]|_(?=_)|T(?=K)")  # how every match of the above begins
_TRIGGERS = ("{", "%", "__", "[", "$$", "@@", "TK")


def filler_share(words: list[str]) -> float:
    return sum(w in _LATIN for w in words) / len(words) if words else 0.0


def unfilled(text: str) -> bool:
    """Does the text, quotations left out, hold an unfilled place of a template?"""
    if not any(t in text for t in _TRIGGERS):
        return False
    if not _holds_place(text):
        return False
    return _holds_place("\n".join(pages._QUOTED.sub(" ", line) for line in text.split("\n")))


def _holds_place(text: str) -> bool:
    """Is there a match of _UNFILLED? It is tried only where one can begin."""
    return any(_UNFILLED.match(text, x.start()) for x in _BEGIN.finditer(text))


def _may_hold_message(low: str) -> bool:
    return any(map(low.__contains__, _KEYS)) or any(map(low.__contains__, _LATIN_KEYS))


def message_line(line: str) -> bool:
    """Is the line (not a paragraph of an article) a message or filler?"""
    low = " ".join(line.lower().split())
    if not _may_hold_message(low):
        return False
    if len(low) < 420 and _MESSAGE.search(pages._QUOTED.sub(" ", low)):
        return True
    words = pages._WORD.findall(low)
    return len(words) >= 5 and filler_share(words) >= 0.6


def _remembered(line: str, cache: dict | None) -> bool:
    if cache is None or len(line) >= 200:
        return message_line(line)
    key = (line,)  # the cache of pages.label_lines has the lines themselves as keys
    if key not in cache:
        cache[key] = message_line(line)
    return cache[key]


def judge(text: str, title: str | None, cache: dict | None = None) -> tuple[int, str, list[int]]:
    """(trusted label, main text, first pass of the block rules over the lines) of a page."""
    lines = text.replace("\r", "").split("\n")
    codes = pages.looks(lines, title, cache)
    labels = pages.settle(codes)
    main = [x for x, y in zip(lines, labels) if y == pages.BODY]
    whole = "\n".join(main)
    if unfilled(text):
        return UNFILLED, whole, codes
    # of long pages only lines of body count; on short ones a message may look like any line
    suspects = main if _may_hold_message(whole.lower()) else []
    if len(whole) < 1200:
        suspects = suspects + [x for x, y in zip(lines, labels) if y == pages.NOISE and len(x) > 25]
    messages = [x for x in suspects if _remembered(x, cache)]
    if not messages:
        return CLEAN, whole, codes
    # filler within an article makes it unfinished, whatever its share
    if any(len(x) > 60 and filler_share(pages._WORD.findall(x.lower())) >= 0.6 for x in messages):
        unfinished = UNFILLED
    else:
        unfinished = CLEAN
    said = sum(map(len, messages))
    rest = sum(len(x) for x in main if x not in messages and len(x) > 60)
    return RESIDUE if said > rest else unfinished, "\n".join(dict.fromkeys([*main, *messages])), codes


_SLUG = re.compile(r"/?\b\w+(?:-\w+){2,}")
_CODE = re.compile(r"[a-f\d](?<!\w[a-f\d])(?:(?<=\d)|[a-f]{0,15}\d)\w*")  # \b[a-f]{0,16}\d\w*, searched by its first character
_NAME = re.compile(r"[A-ZÀ-ÖØ-Þ][\w’']*(?: (?:van|de|of|[A-ZÀ-ÖØ-Þ][\w’']*))*")


def masked(main: str, title: str | None) -> str:
    """Main text without what differs from copy to copy: its title, slugs, codes, figures, names."""
    text = " ".join(main.split())
    if title and len(title) > 8:
        text = text.replace(" ".join(title.split()), " T ")
    if text.count("-") > 1:
        text = _SLUG.sub("S", text)
    return _NAME.sub("N", _CODE.sub("0", text)).lower()


class Memo(dict):
    """Hashes of words, each made once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) | 1
        return found


def shingles(text: str, memo: dict[str, int]) -> np.ndarray:
    """Hashes of the five-word shingles of a text (of all its words, if they are fewer)."""
    return word_shingles(text.split(), memo if isinstance(memo, Memo) else Memo(memo))


def word_shingles(words: list[str], memo: Memo) -> np.ndarray:
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)) if words else np.array([1], dtype=np.uint64)
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(h) - k + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes in ascending order; sorts in place. For the few of a text, faster than np.unique."""
    hashes.sort()
    kept = np.ones(len(hashes), dtype=bool)
    np.not_equal(hashes[1:], hashes[:-1], out=kept[1:])
    return hashes[kept]


_SEEDS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def simhash(hashes: np.ndarray) -> bytes:
    """Majority of each of the 1,024 bits over distinct hashes."""
    bits = np.zeros(64 * WORDS, dtype=np.int64)
    for i in range(0, len(hashes), 255):  # as many as one byte counts
        x = hashes[i : i + 255, None] + _SEEDS
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * bits > len(hashes)).tobytes()


def judged_pages(df: DataFrame, id_col: str = "id", title_col: str = "title", text_col: str = "content", lines: Callable[[str, str | None, list[int]], tuple] | None = None, fields: str = "") -> DataFrame:
    """(id, label, node, text, sim): trusted label, masked main text with its digest and SimHash,
    written to the shared folder. ``lines`` adds ``fields``, made of a page's text, title and codes,
    so that another question can be asked in the same pass over the texts."""
    schema = "id string, label int, node binary, text string, sim binary" + (f", {fields}" if fields else "")
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        memo = Memo()
        for batch in batches:
            rows = []
            for i, title, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text or not text.strip():
                    continue
                label, main, codes = judge(text, title, cache)
                masked_text = masked(main, title) if label != UNFILLED else ""
                node = (xxhash.xxh3_128_digest(masked_text.encode()), masked_text, simhash(distinct(shingles(masked_text, memo)))) if masked_text else (None, None, None)
                rows.append((i, label, *node, *(lines(text, title, codes) if lines else ())))
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    columns = df.select(F.col(id_col).cast("string").alias("id"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
    return stash(columns.where("id is not null").mapInArrow(run, schema))


def keys_of(codes: np.ndarray) -> np.ndarray:
    """Table and bits, as one number, of every table of codes (a row of bytes each): neighbouring
    bytes in the first half of the tables, bytes half a code apart in the second."""
    half = TABLES // 2
    low = np.concatenate([codes[:, 0::2], codes[:, :half]], axis=1)
    high = np.concatenate([codes[:, 1::2], codes[:, half:]], axis=1)
    return np.arange(TABLES, dtype=np.int32) << 16 | high.astype(np.int32) << 8 | low


def _postings(nodes: DataFrame, occupied: np.ndarray | None = None) -> DataFrame:
    """(node, s0, s1, key): every table entry, or those that ``occupied`` has, with the first 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 8 * WORDS)
                keys = keys_of(codes)
                kept = np.ones(keys.shape, dtype=bool) if occupied is None else occupied[keys >> 3] >> (keys & 7).astype(np.uint8) & 1 > 0
                row, at = np.nonzero(kept)
                first = np.ascontiguousarray(codes[:, :16]).view(np.int64)
                columns = [part.column(0).take(pa.array(row)), pa.array(first[row, 0]), pa.array(first[row, 1]), pa.array(keys[row, at])]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "s0", "s1", "key"])

    return nodes.select("node", "sim").mapInArrow(run, "node binary, s0 bigint, s1 bigint, key int")


def _occupied(postings: DataFrame) -> np.ndarray:
    """The keys of postings as a bitmap of 1 MB, however many they are."""
    key = F.col("key") + 1  # the bitmap functions count from 1
    rows = postings.groupBy(F.bitmap_bucket_number(key).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits")).collect()
    out = np.zeros(TABLES << 13, dtype=np.uint8)
    for r in rows:
        at = (r["n"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def linked(frontier: DataFrame, others: DataFrame) -> DataFrame:
    """(node, other): pairs of the nodes of two (node, sim) that share a table entry and are within the distance."""
    known = _postings(frontier)
    met = _postings(others, _occupied(known)).select(F.col("node").alias("other"), F.col("s0").alias("o0"), F.col("s1").alias("o1"), "key")
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("o0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("o1")))
    return known.join(met, "key").where(apart <= DISTANCE).select("node", "other").distinct()


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    memo = Memo()
    out = []
    for x, y in zip(a, b):
        s, t = distinct(shingles(x, memo)), distinct(shingles(y, memo))
        both = len(np.intersect1d(s, t, assume_unique=True))
        out.append(both / (len(s) + len(t) - both))
    return pd.Series(out)


def residue_ids(judged: DataFrame) -> DataFrame:
    """(id): pages that are residue as a whole, or have unfilled places of a template.

    ``judged`` comes from judged_pages.
    """
    nodes = judged.where("node is not null").groupBy("node").agg(F.max((F.col("label") == RESIDUE).cast("int")).alias("trusted"), F.first("sim").alias("sim"))
    texts = judged.where("node is not null").select("node", "text").dropDuplicates(["node"])
    others = nodes.where("trusted = 0").select("node", "sim")
    marked, frontier = nodes.where("trusted = 1").select("node"), nodes.where("trusted = 1").select("node", "sim")
    while True:
        pairs = linked(frontier, others.join(marked, "node", "left_anti")).withColumnRenamed("node", "from").withColumnRenamed("other", "node")
        near = pairs.join(texts.select(F.col("node").alias("from"), F.col("text").alias("a")), "from").join(texts.withColumnRenamed("text", "b"), "node")
        reached = near.where(_agreement("a", "b") >= SIMILAR).select("node").distinct()
        new = stash(others.join(reached, "node", "left_semi"))
        if new.isEmpty():
            break
        marked, frontier = marked.unionByName(new.select("node")), new
    whole = judged.join(marked, "node", "left_semi").select("id")
    return whole.unionByName(judged.where(F.col("label") == UNFILLED).select("id")).distinct()
