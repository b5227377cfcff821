"""Line-first quality rules, in DataFrame expressions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are removed,
and a document that loses too large a share of its text, or fails the base rule, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import col, fresh, let, words

#: Phrases of site furniture in English, German, French and Spanish, for lines of at most
#: ``FURNITURE_WORDS`` words; and a year of copyright in any language.
FURNITURE = (
    "all rights reserved|cookie policy|privacy policy|terms of (use|service)|accept (all )?cookies|enable javascript"
    "|click here|subscribe (now|to our)|sign up for|share (this|on)|powered by|skip to (main )?content|lorem ipsum"
    "|alle rechte vorbehalten|cookie-richtlinie|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|javascript aktivieren"
    "|hier klicken|(newsletter|jetzt) abonnieren|teilen auf|zum inhalt springen"
    "|tous droits réservés|politique de (cookies|confidentialité)|conditions d.utilisation|accepter les cookies|activer javascript"
    "|cliquez ici|abonnez-vous|partager sur|aller au contenu"
    "|todos los derechos reservados|política de (cookies|privacidad)|términos (de uso|y condiciones)|aceptar (las )?cookies"
    "|haga clic aquí|suscríbete|compartir en|saltar al contenido"
    "|(©|[(]c[)]|copyright) ?[0-9]{4}"
)
FURNITURE_WORDS = 30
#: A line that is one of these is navigation; so is, in any language, a row of things between
#: separators, and one that is mostly addresses.
MENU = (
    "(home|menu|login|log in|sign in|sign up|register|contact( us)?|about( us)?|search|next|previous|back to top|site ?map"
    "|startseite|menü|anmelden|registrieren|kontakt|über uns|suche|weiter|zurück|nach oben|impressum"
    "|accueil|connexion|inscription|contactez-nous|à propos|recherche|suivant|précédent|haut de page|plan du site"
    "|inicio|menú|iniciar sesión|registrarse|contacto|quiénes somos|buscar|siguiente|anterior|volver arriba|mapa del sitio)"
)
#: Largest share of word characters that may be lost with removed lines, in percent.
MAX_LOST = 30


def _count(line: Column, pattern: str) -> Column:
    """Characters of ``line`` outside ``pattern``, a negated set."""
    return F.length(F.regexp_replace(line, pattern, ""))


def n_repeat_words(own: Column) -> Column:
    """Words in windows of five that occur twice or more in the text, in n log n of its words."""

    def spans(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k + 1 < F.size(at), F.least(F.lit(5), F.get(at, k + 1) - p)).otherwise(F.lit(5)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def places(pairs: Column) -> Column:
        same = lambda p, q: F.coalesce(F.get(pairs, q)["h"] == p["h"], F.lit(False))
        twice = F.filter(F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"])), lambda p: p.isNotNull())
        return let(F.sort_array(twice), spans)

    def windows(h: Column) -> Column:
        last = F.size(h) - 5
        gram = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5))))
        return let(
            gram,
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
                let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)
            ),
        )

    return F.when(F.size(own) < 6, F.lit(0).cast("long")).otherwise(let(F.transform(own, lambda w: F.xxhash64(w)), windows))


def _verdict(line: Column, n: Column) -> Column:
    """Which rule a line of ``n`` words fails: punctuation, navigation, boilerplate, or '' for none."""
    low = F.lower(line)
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    marks = _count(line, "[^#*$%&<>]+")
    bars = _count(line, "[^|»·]+")
    ends = _count(line, "[^.!?:;,]+")
    punctuation = (shouts * 4 >= n) & (shouts >= 2) | (marks * 2 >= n) & (marks >= 4) | (n >= 40) & (ends == 0)
    links = (F.length(low) - F.length(F.replace(low, F.lit("://"), F.lit("")))) / 3
    navigation = (bars >= 3) & (bars * 5 >= n) | (links >= 2) & (links * 2 >= n) | (n <= 3) & F.trim(low).rlike(f"^{MENU}$")
    furniture = (n <= FURNITURE_WORDS) & low.rlike(FURNITURE)
    return F.when(punctuation, "punctuation").when(navigation, "navigation").when(furniture, "boilerplate").otherwise("")


def _facts(text: Column) -> Column:
    """All figures of one text as a struct; each part is computed once."""

    def judged(lines: Column) -> Column:
        def one(line: Column) -> Column:
            return let(
                words(line),
                lambda w: F.struct(
                    line.alias("line"), F.size(w).alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"),
                    F.when(F.size(w) == 0, F.lit("")).otherwise(_verdict(line, F.size(w))).alias("rule"),
                ),
            )

        return F.transform(lines, one)

    def by_line(lines: Column) -> Column:
        def sum_up(j: Column) -> Column:
            full = F.transform(F.filter(j, lambda x: x["n"] > 0), lambda x: x["line"])
            failed = lambda rule: F.size(F.filter(j, lambda x: x["rule"] == rule)).cast("long")
            return F.struct(
                let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                failed("punctuation").alias("n_punctuation"), failed("navigation").alias("n_navigation"), failed("boilerplate").alias("n_boilerplate"),
                F.aggregate(j, F.lit(0).cast("long"), lambda a, x: a + F.when(x["rule"] == "", 0).otherwise(x["chars"])).alias("lost_chars"),
                F.array_join(F.transform(F.filter(j, lambda x: x["rule"] == ""), lambda x: x["line"]), "\n").alias("clean_text"),
            )

        return let(judged(lines), sum_up)

    def by_word(own: Column) -> Column:
        return F.struct(
            F.size(own).cast("long").alias("n_words"), F.length(F.array_join(own, "")).cast("long").alias("word_chars"), n_repeat_words(own).alias("n_repeat_words")
        )

    return F.struct(
        let(words(text), by_word).alias("w"), let(F.split(text, "\n", -1), by_line).alias("l"), _count(text, "[^#*$%&|<>]+").cast("long").alias("n_symbols")
    )


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """One row per document with the base figures, lines failed by rule, and the verdict.

    Null text: no words, all figures 0, ``base_failed`` true, ``clean_text`` null. Empty texts are
    alike with an empty ``clean_text``. Null ids and repeated rows pass through; an empty table
    gives no row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).select("doc_id", F.col("text").isNull().alias("none"), let(text, _facts).alias("f"))
    n, rep = F.col("f.w.n_words"), F.col("f.w.n_repeat_words")
    failed = (n < 10) | (rep * 100 > n * 20)
    lost = F.col("f.l.lost_chars")
    return rows.select(
        "doc_id", n.alias("n_words"), "f.w.word_chars", "f.n_symbols", "f.l.n_dup_lines", rep.alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & (lost * 100 <= F.col("f.w.word_chars") * max_lost)).alias("kept"),
        "f.l.n_punctuation", "f.l.n_navigation", "f.l.n_boilerplate", "f.l.lost_chars", F.when(~F.col("none"), F.col("f.l.clean_text")).alias("clean_text"),
    )


def apply(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` with all their columns, without rejected documents, the texts without failing lines."""
    made, none = fresh(docs.columns, "facts"), F.coalesce(col(text_col), F.lit(""))


    def kept(f: Column) -> Column:
        n = f["w"]["n_words"]
        return (n >= 10) & (f["w"]["n_repeat_words"] * 100 <= n * 20) & (f["l"]["lost_chars"] * 100 <= f["w"]["word_chars"] * max_lost)

    # Not a filter over a projection: that would be pushed below it and judge every text again.
    rows = docs.select("*", F.explode(F.filter(F.array(let(none, _facts)), kept)).alias(made))
    f = lambda path: F.col(f"{made}.{path}")
    out = []
    for c, field in zip(docs.columns, docs.schema):
        if c == text_col:
            out.append(f("l.clean_text").alias(c))
        elif c == length_col:
            out.append(F.when(f("l.lost_chars") > 0, F.length(f("l.clean_text"))).otherwise(col(c)).cast(field.dataType).alias(c))
        else:
            out.append(col(c))
    return rows.select(*out)
