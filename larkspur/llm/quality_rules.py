"""Quality rules: clean line by line, then reject documents that lose too much.

Every line faces the rules for punctuation, navigation and boilerplate; the lines that fail
are dropped and a document that keeps too small a share of its characters, or too few words,
is rejected. Everything is a projection over the row at hand: no shuffle, no Python, no state.

Defined cases: null and empty texts have one empty line, no words, and fail the base rules;
an empty table gives an empty result; repeated rows are judged alike, each by itself; long
texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import BLANKS, bare, documents, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: Phrases of notices and page furniture in English, French, German and Spanish, matched in lower case anywhere in a line.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
    "use cookies", "javascript", "lorem ipsum", "licensed under", "copyright ©", "(c) copyright",
    "click here", "read more", "subscribe to our", "powered by",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "cliquez ici", "lire la suite",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "klicken sie hier", "mehr lesen",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "utiliza cookies", "haga clic aquí", "leer más",
)
#: Whole lines that only lead elsewhere, in the same languages.
NAVIGATION = (
    "home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "contact",
    "contact us", "about", "about us", "next", "previous", "back", "back to top", "top", "share",
    "print", "sitemap", "skip to content",
    "accueil", "rechercher", "connexion", "s'inscrire", "à propos", "suivant", "précédent", "retour", "haut de page", "partager", "imprimer", "plan du site",
    "startseite", "menü", "suche", "anmelden", "registrieren", "kontakt", "über uns", "weiter", "zurück", "nach oben", "teilen", "drucken",
    "inicio", "menú", "buscar", "iniciar sesión", "registrarse", "contacto", "acerca de", "siguiente", "anterior", "volver", "arriba", "compartir", "imprimir", "mapa del sitio",
)


#: A mark at the end of a line, or at the end of a sentence within it.
ENDS, WITHIN = "[.!?…。！？:;,][\"'”’»)\\]]*$", "[.!?…。！？]"
_NOTICES = "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE)


def _without(text: Column, chars: str) -> Column:
    """The text less some characters; one replace() each, which is far cheaper than translate() on long texts."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words in windows of ``window`` words that the same text holds twice or more.

    Hashes of the windows say whether any can repeat, which few texts need to go beyond;
    the windows themselves decide where one does. A word is hashed once; windows of 2, 4, ... words come from hashes of half as many.
    """

    def exact(ws: Column) -> Column:
        keyed = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(ws) - window),
                lambda i: F.struct(F.array_join(F.slice(ws, i + 1, window), " ").alias("k"), i.alias("i")),
            )
        )

        def twice(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["k"] == F.get(s, k)["k"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda at, j: F.least(F.lit(window), F.coalesce(at - F.get(p, j - 1), F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(keyed, twice), covered)

    def longer(hashes: Column, held: int, then) -> Column:
        """Hashes of stretches of ``held`` words -> those of ``window`` words, of which the last overlap where that isn't a power of two."""
        if held == window:
            return then(F.slice(hashes, 1, F.size(hashes) - window + 1))
        step = min(held, window - held)
        joined = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))
        return let(joined, lambda h: longer(h, held + step, then))

    def screened(ws: Column) -> Column:
        decide = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(ws))
        return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: longer(h, 1, lambda x: let(x, decide)))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(screened(words)).cast("long")


def line_passes(line: Column, min_line_words: int = 1, long_line_words: int = 30) -> Column:
    """The rules a line must meet. Blank lines pass: they cost a document nothing. One notice condemns a line of up to
    ``long_line_words`` words, two a line of twice as many, and so on; a line of that many words may end without a mark if a
    sentence ends within it."""

    def judged(t: Column) -> Column:
        low, chars = F.lower(t), F.length(t)
        n_words = chars - F.length(_without(t, BLANKS)) + 1
        symbols = chars - F.length(_without(t, SYMBOLS))
        shouts = chars - F.length(_without(t, "!"))
        punctuation = (
            (t.rlike(ENDS) | ((n_words >= long_line_words) & t.rlike(WITHIN)))
            & (symbols * 10 <= chars)
            & (shouts * 3 <= n_words + 2)
            & (n_words >= min_line_words)
        )
        navigation = ((chars - F.length(_without(t, "|"))) * 10 < n_words + 10) & ~low.isin(*NAVIGATION)
        # Searching for one phrase after the other is far cheaper than one pattern; few lines go on to be counted.
        notices = let(low, lambda x: F.when(reduce(or_, [F.contains(x, F.lit(p)) for p in BOILERPLATE]), F.regexp_count(x, F.lit(_NOTICES))).otherwise(0))
        boilerplate = notices * long_line_words <= n_words
        return (t == "") | (punctuation & navigation & boilerplate)

    return let(bare(line), judged)


def quality_rules(
    docs: DataFrame,
    *,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    window: int = 8,
    max_lost: float = 0.5,
) -> DataFrame:
    """Per row: doc_id, the base counts, ``base_failed``, ``kept``, and the ``clean_text`` of the
    lines that pass (given for rejected documents too), with ``lines_dropped`` and ``lost`` (the share of characters).
    """
    text = text_of(docs)
    base = docs.select("doc_id", text.alias("t"))
    lines = F.split(F.col("t"), "\n", -1)
    with_word = F.filter(lines, lambda x: bare(x) != "")
    bare_chars = F.length(_without(F.col("t"), BLANKS))

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws, window).alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        good = F.filter(ls, lambda x: line_passes(x))
        return let(
            good,
            lambda g: F.struct((F.size(ls) - F.size(g)).cast("long").alias("lines_dropped"), F.array_join(g, "\n").alias("clean_text")),
        )

    counted = base.select(
        "doc_id",
        bare_chars.cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(with_word, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        let(words_of(F.col("t")), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
    )
    flat = counted.select("doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "l.lines_dropped", "l.clean_text")
    clean_chars = F.length(_without(F.col("clean_text"), BLANKS))
    lost = F.when(F.col("word_chars") > 0, 1 - clean_chars / F.col("word_chars")).otherwise(0.0)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return flat.withColumns({"base_failed": failed, "lost": lost}).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))


def op1_quality_rules(spark, sf_dir):
    found = quality_rules(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, k FROM w GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT w.doc_id, unnest(range(i, i + 8)) AS p FROM w JOIN twice USING (doc_id, k)) GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_replace(line, '^{blank}+|{blank}+$', '', 'g') AS b FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
j AS (SELECT *, length(b) - length(regexp_replace(b, '{blank}', '', 'g')) + 1 AS n, length(b) - length(regexp_replace(b, '[#*$%&|<>]', '', 'g')) AS symbols,
             length(b) - length(replace(b, '!', '')) AS shouts, length(b) - length(replace(b, '|', '')) AS bars FROM l),
v AS (SELECT *, b = '' OR ((regexp_matches(b, {quoted(ENDS)}) OR n >= 30 AND regexp_matches(b, {quoted(WITHIN)}))
             AND symbols * 10 <= length(b) AND shouts * 3 <= n + 2 AND n >= 1 AND bars * 10 < n + 10 AND lower(b) NOT IN ({", ".join(map(quoted, NAVIGATION))})
             AND len(regexp_extract_all(lower(b), {quoted(_NOTICES)})) * 30 <= n) AS ok FROM j),
g AS (SELECT doc_id, count(*) FILTER (b <> '') - count(DISTINCT line) FILTER (b <> '') AS dup,
             coalesce(sum(length(regexp_replace(line, '{blank}', '', 'g'))) FILTER (ok), 0) AS clean FROM v GROUP BY doc_id),
c AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '{blank}', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, dup, clean, coalesce(rep.n, 0) AS reps
      FROM d JOIN g ON d.doc_id = g.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * reps > 30 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
       CAST(reps AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND (word_chars = 0 OR 1 - clean / word_chars <= 0.5) AS kept
FROM f
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE = {"op1_quality_rules": _sql()}
