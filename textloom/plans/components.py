"""Statistics as pipeline stages: Transformers that append a struct column to documents."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import ParameterError, SourceError
from ..functions.text import has_word, is_number
from ..operators import basic, cohesion, diversity, lexical, morphology, phonetics, style, syntax
from ..operators.words import words

#: Columns of an element of `tokens`, the annotation that a tagger or parser leaves in a document's row.
TOKENS = "array<struct<sent_id:int,idx:int,form:string,lemma:string,upos:string,feats:string,head:int,deprel:string>>"
READABILITY = ("flesch_reading_easy", "flesch_kincaid_grade", "coleman_liau_index", "automated_readability_index", "smog_index", "gunning_fog_index", "lix", "rix", "mu_index", "consensus_grade", "reading_time")
UNADAPTED = ("forcast", "linsear_write", "powers_sumner_kearl", "eflaw", "wiener_1", "wiener_2", "wiener_3", "wiener_4", "dickes_steiwer", "gulpease", "fucks", "strain_index", "elf", "wheeler_smith")


class StatsComponent(Transformer):
    """Appends `name`, a struct of statistics by doc_id; documents that accepts() refuses get null."""

    name = "stats"

    def __init__(self, **options):
        super().__init__()
        self.options = options

    def accepts(self):
        """Which documents get statistics: those with a word."""
        return has_word(F.coalesce(F.col("text"), F.lit("")))

    def prepare(self, df: DataFrame) -> DataFrame:
        """The documents that the statistics are computed of."""
        return df.where(self.accepts())

    def compute(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def from_extension(self, df: DataFrame, name: str) -> DataFrame:
        """The statistics that an earlier stage left in a column."""
        if name not in df.columns:
            raise SourceError(f"no stage before this one left a column {name}")
        return df.where(F.col(name).isNotNull()).select("doc_id", f"{name}.*")

    #: Whether columns that earlier stages left are read.
    of_stages = False

    def _transform(self, df: DataFrame) -> DataFrame:
        # statistics are computed of the documents before all stages, so that a chain of stages doesn't repeat itself
        documents = getattr(df, "_documents", df)
        found = self.compute(self.prepare(df if self.of_stages else documents))
        cols = [c for c in found.columns if c != "doc_id"]
        out = df.join(found.select("doc_id", F.struct(*cols).alias(self.name)), "doc_id", "left")
        out._documents = documents
        return out


class BasicStatsComponent(StatsComponent):
    name = "basic"

    def compute(self, df: DataFrame) -> DataFrame:
        return basic.basic_stats(df, **self.options)


class _OfBasicStats(StatsComponent):
    """Reads the column `basic` where an earlier stage left one, so that texts are counted once; basic: another name."""

    columns: tuple[str, ...] = ()
    of_stages = True

    def compute(self, df: DataFrame) -> DataFrame:
        options = dict(self.options)
        name = options.pop("basic", None)
        stats = self.from_extension(df, name or "basic") if name or "basic" in df.columns else basic.basic_stats(df)
        return basic.readability(stats, **options).select("doc_id", *self.columns)


class ReadabilityStatsComponent(_OfBasicStats):
    name, columns = "readability", READABILITY


class UnadaptedReadabilityStatsComponent(_OfBasicStats):
    """The formulas made for English, German and Italian, with their published coefficients."""

    name, columns = "unadapted_readability", UNADAPTED


class DiversityStatsComponent(StatsComponent):
    name = "diversity"

    def compute(self, df: DataFrame) -> DataFrame:
        return diversity.diversity(words(df), **self.options)


class LexicalStatsComponent(StatsComponent):
    """dictionary: a table of lemma, ipm, range, dispersion, rank; without one, dictionary_of the documents themselves
    (parts: the column `part`, source by default), which needs words of at least min_freq occurrences."""

    name = "lexical"

    def accepts(self):
        from ..functions.text import as_words

        return F.exists(as_words(F.col("text")), lambda w: ~is_number(w))

    def compute(self, df: DataFrame) -> DataFrame:
        options = dict(self.options)
        dictionary, part = options.pop("dictionary", None), options.pop("part", "source")
        if dictionary is None:
            if part not in df.columns:
                raise ParameterError(f"a dictionary, or documents with a column {part}, are needed")
            dictionary = lexical.dictionary_of(words(df, filter_numbers=True).join(df.select("doc_id", part), "doc_id"), part)
        return lexical.lexical_stats(words(df, filter_numbers=True), dictionary, **options)


class StyleStatsComponent(StatsComponent):
    name = "style"

    def compute(self, df: DataFrame) -> DataFrame:
        return style.style_stats(words(df), **self.options)


class PhonStatsComponent(StatsComponent):
    name = "phonetics"

    def compute(self, df: DataFrame) -> DataFrame:
        return phonetics.phon_stats(words(df), **self.options)


class _OfTokens(StatsComponent):
    """Needs the column `tokens` (TOKENS)."""

    def prepare(self, df: DataFrame) -> DataFrame:
        if "tokens" not in df.columns:
            raise SourceError("documents need a column tokens, which a parser leaves")
        return df.where(F.exists("tokens", lambda t: has_word(t["form"]))).select("doc_id", F.inline("tokens"))


class SyntaxStatsComponent(_OfTokens):
    name = "syntax"

    def compute(self, df: DataFrame) -> DataFrame:
        return syntax.syntax_stats(df, **self.options)


class MorphStatsComponent(_OfTokens):
    """counts: a map of statistic -> map of value -> number."""

    name = "morphology"

    def compute(self, df: DataFrame) -> DataFrame:
        rows = morphology.morph_stats(syntax.with_features(df).where(has_word(F.col("form"))), **{"filter_none": True, **self.options})
        per = rows.groupBy("doc_id", "stat").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("values"))
        return per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("stat", "values"))).alias("counts"))


class CohesionStatsComponent(StatsComponent):
    """All cohesion statistics of documents with the column `tokens`; of plain texts, the overlaps of their words."""

    name = "cohesion"

    def compute(self, df: DataFrame) -> DataFrame:
        if "tokens" not in df.columns:
            return cohesion.overlaps(cohesion.sentence_sets(df, **self.options))
        rows = df.select("doc_id", F.posexplode("tokens").alias("pos", "t")).select("doc_id", "pos", "t.*").where(has_word(F.col("form"))).withColumn("paragraph", F.col("sent_id"))
        return cohesion.cohesion_stats(syntax.with_features(rows), **self.options)


CLASSES = {c.name: c for c in (BasicStatsComponent, ReadabilityStatsComponent, UnadaptedReadabilityStatsComponent, DiversityStatsComponent, LexicalStatsComponent, StyleStatsComponent, PhonStatsComponent, SyntaxStatsComponent, CohesionStatsComponent, MorphStatsComponent)}
