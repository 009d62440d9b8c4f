"""Line-first quality rules: lines are judged and removed first, then documents that lose too much."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutemill.llm.chunks import release
from minutemill.llm.common import BREAKS, id_and_text, map_batches, read_documents, slices

SYMBOLS = "#*$%&|<>"
# Fixed values of the line rules. A line is judged on its characters outside white space.
SEPARATORS = "|<>"
NAVIGATION = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back to top",
    "skip to content", "read more", "share", "search", "contact", "contact us", "about", "about us", "sitemap",
    "startseite", "anmelden", "abmelden", "registrieren", "weiter", "nach oben", "weiterlesen", "mehr lesen", "suche", "kontakt",
    "impressum", "accueil", "connexion", "se connecter", "suivant", "lire la suite", "partager", "rechercher", "nous contacter",
    "plan du site", "inicio", "iniciar sesión", "registrarse", "siguiente", "anterior", "leer más", "compartir", "buscar",
    "contacto", "mapa del sitio",
)
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "uses cookies", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "subscribe to our newsletter", "click here", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "cookies akzeptieren", "nutzungsbedingungen",
    "newsletter abonnieren", "hier klicken", "tous droits réservés", "politique de confidentialité", "utilise des cookies",
    "accepter les cookies", "conditions d'utilisation", "cliquez ici", "todos los derechos reservados", "política de privacidad",
    "utiliza cookies", "aceptar cookies", "aceptar las cookies", "términos de uso", "haga clic aquí",
)
# A phrase must make up at least this share of the line's characters: prose that mentions one stays.
PHRASE_PERCENT = 25
# At most this share of a line may be ASCII punctuation; words that a document may lose with its lines.
PUNCTUATION_PERCENT, LOST_PERCENT = 30, 50
# Below this many words a text is too short, and above this share of repeated words too repetitive.
LEAST_WORDS, REPEAT_PERCENT = 10, 20

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NOT_PUNCTUATION = re.compile("[^" + re.escape(_PUNCTUATION) + "]+")
_LONGEST = 100 * max(map(len, BOILERPLATE))
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def line_fails(line: str) -> bool:
    """Whether a line with at least one word fails the punctuation, navigation or boilerplate rule.

    Punctuation: more than 30 % of its characters are ASCII punctuation. Navigation: two or more of the
    separators | < > that make up a tenth of its characters, or the line is a navigation label as a
    whole. Boilerplate: it contains one of the phrases, which makes up a quarter of its characters or more
    (white space counted, except at its ends). ASCII letters compare without case.
    """
    packed = line.translate(_NO_BREAKS)
    n = len(packed)
    if 100 * len(_NOT_PUNCTUATION.sub("", packed)) > PUNCTUATION_PERCENT * n:
        return True
    separators = sum(packed.count(c) for c in SEPARATORS)
    if separators >= 2 and 10 * separators >= n:
        return True
    lower = line.translate(_LOWER).strip(BREAKS)
    if lower in NAVIGATION:
        return True
    least = PHRASE_PERCENT * len(lower)
    return least <= _LONGEST and any(100 * len(p) >= least and p in lower for p in BOILERPLATE)


_NO_BREAKS = {ord(c): None for c in BREAKS}


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that stand in a window of `size` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    number: dict[tuple, int] = {}
    ids = [number.setdefault(w, len(number)) for w in windows]
    if len(number) == len(ids):
        return 0
    ids = np.array(ids)
    edges = np.zeros(len(words) + 1, np.int64)
    again = np.nonzero(np.bincount(ids)[ids] > 1)[0]
    np.add.at(edges, again, 1)
    np.add.at(edges, again + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judge(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words, base_failed, kept, cleaned)."""
    words = text.encode().split()
    lines = text.split("\n")
    seen: set[str] = set()
    kept_lines, n_dup, n_kept = [], 0, 0
    for line in lines:
        n = len(line.encode().split())
        if n:
            n_dup += line in seen
            seen.add(line)
            if line_fails(line):
                continue
            n_kept += n
        kept_lines.append(line)
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
    kept = not failed and 100 * (len(words) - n_kept) <= LOST_PERCENT * len(words)
    return (
        len(words), len(b"".join(words).decode()), sum(text.count(c) for c in SYMBOLS), n_dup, repeated,
        n_kept, failed, kept, "\n".join(kept_lines),
    )


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_kept_words long, "
    "base_failed boolean, kept boolean, cleaned string"
)


def quality_rules(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, n_kept_words and the cleaned text.

    A null text has no words, so it fails, as an empty one does. A null doc_id stays null. Repeated rows
    give repeated rows, other columns are left behind, an empty table gives an empty one.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    drop = () if with_text else ("cleaned",)
    schema = ", ".join(["doc_id long", *(f for f in FIELDS.split(", ") if f.split()[0] not in drop)])

    def run(batch):
        for rows in slices(batch):
            judged = list(zip(*map(judge, rows.column("text").to_pylist())))
            columns = {n: list(c) for n, c in zip(names, judged) if n not in drop}
            yield {"doc_id": rows.column("doc_id"), **columns}

    return map_batches(id_and_text(docs), run, schema)


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, without the lines that failed; the columns of the input.

    n_chars, where there is such a column, counts the characters of the cleaned text. All columns pass
    through the judging, so ids may be null or repeat and other columns may have any name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target, at = to_arrow_schema(docs.schema), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        release()
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            judged = [judge(t or "") for t in batch.column(at).to_pylist()]
            keep = [i for i, j in enumerate(judged) if j[-2]]
            rows = batch.take(pa.array(keep, pa.int64()))
            columns = list(rows.columns)
            texts = [judged[i][-1] for i in keep]
            columns[at] = pa.array(texts, target.field(at).type)
            if "n_chars" in target.names:
                place = target.names.index("n_chars")
                columns[place] = pa.array([len(t) for t in texts], pa.int64()).cast(target.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_documents(spark, sf_dir), with_text=False)


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _holds(phrase: str) -> str:
    return f"({100 * len(phrase)} >= {PHRASE_PERCENT} * length(lower_line) AND contains(lower_line, {_sql_list([phrase])}))"


_WORDS = r"'[^\x20\x09-\x0D]+'"
ORACLE = {
    "op4_quality_rules": f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    worded AS (SELECT doc_id, text, regexp_extract_all(text, {_WORDS}) AS w FROM docs),
    lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM docs),
    judged AS (
      SELECT doc_id, line, i, len(regexp_extract_all(line, {_WORDS})) AS n,
        regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g') AS packed,
        regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS lower_line
      FROM lines),
    checked AS (
      SELECT doc_id, line, i, n,
        row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
        100 * length(regexp_replace(packed, '[^!-/:-@\\[-`{{-~]', '', 'g')) > {PUNCTUATION_PERCENT} * length(packed)
        OR (length(regexp_replace(packed, '[^|<>]', '', 'g')) >= 2
            AND 10 * length(regexp_replace(packed, '[^|<>]', '', 'g')) >= length(packed))
        OR lower_line IN ({_sql_list(NAVIGATION)})
        OR {" OR ".join(_holds(p) for p in BOILERPLATE)} AS fails
      FROM judged WHERE n > 0),
    per_line AS (
      SELECT doc_id, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS n_kept
      FROM checked GROUP BY doc_id),
    windows AS (
      SELECT doc_id, p, w[p] || chr(10) || w[p+1] || chr(10) || w[p+2] || chr(10) || w[p+3] || chr(10) || w[p+4] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM worded WHERE len(w) >= 5)),
    again AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (
      SELECT doc_id, count(DISTINCT q) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM again) GROUP BY doc_id),
    counted AS (
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept_words
      FROM worded d LEFT JOIN per_line USING (doc_id) LEFT JOIN covered USING (doc_id)),
    failed AS (
      SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM counted)
    SELECT *, NOT base_failed AND 100 * (n_words - n_kept_words) <= {LOST_PERCENT} * n_words AS kept FROM failed
    """
}
QUERIES = {"op4_quality_rules": op4_quality_rules}
