"""Hierarchical lineage text (level, optional pointer, tag, value) to typed tables, with built-in expressions only.

A record begins with a line of level 0 and is one row of the scan, so a file is split between tasks by records. Inside
a record windows recover to which line of level 1, 2 and 3 each line belongs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.plans.tables import pointer

#: The tags read as events.
EVENT_TAGS = ["BIRT", "DEAT", "RESI", "OCCU", "EVEN", "IMMI", "CENS", "NATU"]
LINE = r"^\s*(\d+)\s+(?:(@[^@\s]+@)\s+)?(\w+)(?: (.*))?$"


class LineageText:
    """The tables of one or more files: individuals, families, events, citations, sources, repositories.

    Lines that do not fit the grammar are skipped; CONT and CONC lines are joined to the line they continue, a missing
    value is null. Of repeated NAME, SEX, BIRT and DEAT the first counts, of repeated FAMC the last.
    """

    def __init__(self, spark: SparkSession, path: str | list[str]):
        self.spark = spark
        raw = spark.read.option("lineSep", "\n0 ").text(path)
        # file order: the file, the block in it, and the running number inside the task's block
        raw = raw.select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("rec"))
        text = F.when(F.regexp_replace("value", "^﻿", "").rlike(r"^0\s"), F.regexp_replace("value", "^﻿", "")).otherwise(F.concat(F.lit("0 "), F.col("value")))
        lines = raw.select("rec", F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
        part = lambda k: F.nullif(F.regexp_extract("line", LINE, k), F.lit(""))
        lines = lines.select("rec", "pos", part(1).cast("int").alias("level"), part(2).alias("xref"), part(3).alias("tag"), part(4).alias("value")).where("level is not null")
        by_pos = Window.partitionBy("rec").orderBy("pos")
        more = F.col("tag").isin("CONT", "CONC")
        lines = lines.withColumn("owner", F.last(F.when(~more, F.col("pos")), ignorenulls=True).over(by_pos))
        piece = F.when(F.col("tag") == "CONT", F.concat(F.lit("\n"), F.coalesce("value", F.lit("")))).otherwise(F.coalesce("value", F.lit("")))
        first = lambda c: F.min_by(c, "pos").alias(c)
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", piece.alias("t")))), lambda x: x["t"]), "")
        joined = lines.groupBy("rec", "owner").agg(first("level"), first("xref"), first("tag"), F.nullif(whole, F.lit("")).alias("value")).withColumnRenamed("owner", "pos")
        # the line of each upper level that a line stands under
        for k in (1, 2, 3):
            here = F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(by_pos)
            joined = joined.withColumn(f"l{k}", F.when(F.col("level") >= k, here))
        joined = joined.withColumn("root_tag", F.first(F.when(F.col("level") == 0, F.col("tag")), ignorenulls=True).over(by_pos)).withColumn("root", F.first(F.when(F.col("level") == 0, F.col("xref")), ignorenulls=True).over(by_pos))
        self.lines = joined.withColumn("id", pointer(F.col("root")))

    def _of(self, tag: str) -> DataFrame:
        return self.lines.where((F.col("root_tag") == tag) & F.col("id").isNotNull())

    @staticmethod
    def _first(cond: Column, out: str) -> Column:
        return F.min_by("value", F.when(cond, F.col("pos"))).alias(out)

    def _level1(self, df: DataFrame, **tags: str) -> DataFrame:
        cols = [self._first((F.col("level") == 1) & (F.col("tag") == tag), name) for name, tag in tags.items()]
        return df.groupBy("rec", "id").agg(*cols)

    def events(self) -> DataFrame:
        """(individual_id, event_ord, type, date, place, description, notes, rec, at): at is the event's line."""
        l = self._of("INDI")
        heads = l.where((F.col("level") == 1) & F.col("tag").isin(EVENT_TAGS)).select("rec", F.col("pos").alias("at"), F.col("tag").alias("type"))
        heads = heads.withColumn("event_ord", (F.row_number().over(Window.partitionBy("rec").orderBy("at")) - 1).cast("int"))
        under = l.where(F.col("level") <= 2).join(heads, "rec").where(F.col("l1") == F.col("at"))
        sub = lambda tag: (F.col("level") == 2) & (F.col("tag") == tag)
        notes = F.transform(F.sort_array(F.collect_list(F.when(sub("NOTE"), F.struct("pos", "value")))), lambda x: x["value"])
        g = under.groupBy("rec", F.col("id").alias("individual_id"), "at", "type", "event_ord").agg(self._first(sub("DATE"), "date"), self._first(sub("PLAC"), "place"), self._first(sub("TYPE"), "kind"), notes.alias("notes"))
        return g.select("individual_id", "event_ord", "type", "date", "place", F.when(F.col("type") == "EVEN", F.col("kind")).alias("description"), "notes", "rec", "at")

    def citations(self) -> DataFrame:
        """(individual_id, event_ord, cite_ord, source_id, page, text, url) of events; a citation without a source is dropped."""
        ev = self.events().select("rec", "at", "event_ord")
        l = self._of("INDI").where(F.col("level") >= 2).join(ev, "rec").where(F.col("l1") == F.col("at"))
        heads = l.where((F.col("level") == 2) & (F.col("tag") == "SOUR")).select("rec", "event_ord", F.col("pos").alias("c"), pointer(F.col("value")).alias("source_id")).where("source_id is not null")
        heads = heads.withColumn("cite_ord", (F.row_number().over(Window.partitionBy("rec", "event_ord").orderBy("c")) - 1).cast("int"))
        under = l.join(heads, ["rec", "event_ord"]).where(F.col("l2") == F.col("c"))
        is_ = lambda level, tag: (F.col("level") == level) & (F.col("tag") == tag)
        g = under.groupBy(F.col("id").alias("individual_id"), "rec", "event_ord", "cite_ord", "source_id").agg(self._first(is_(3, "PAGE"), "page"), self._first(is_(4, "TEXT"), "text"), self._first(is_(4, "WWW"), "url"))
        return g.drop("rec")

    def individuals(self) -> DataFrame:
        l = self._of("INDI")
        is1 = lambda tag: (F.col("level") == 1) & (F.col("tag") == tag)
        many = lambda tag: F.transform(F.sort_array(F.collect_list(F.when(is1(tag), F.struct("pos", "value")))), lambda x: x["value"])
        name_at = l.where(is1("NAME")).groupBy("rec").agg(F.min("pos").alias("name_at"))
        base = l.groupBy("rec", "id").agg(
            self._first(is1("NAME"), "full"), self._first(is1("SEX"), "sex"), F.max_by("value", F.when(is1("FAMC"), F.col("pos"))).alias("famc"), many("FAMS").alias("fams"), F.filter(many("NOTE"), lambda x: x.isNotNull()).alias("notes"))
        parts = l.where(F.col("level") == 2).join(name_at, "rec").where(F.col("l1") == F.col("name_at")).groupBy("rec").agg(self._first(F.col("tag") == "GIVN", "givn"), self._first(F.col("tag") == "SURN", "surn"))
        vital = self.events().where(F.col("type").isin("BIRT", "DEAT"))
        one = lambda type_, p: vital.where(F.col("type") == type_).groupBy("rec").agg(F.min_by("date", "event_ord").alias(f"{p}_date"), F.min_by("place", "event_ord").alias(f"{p}_place"))
        j = base.join(parts, "rec", "left").join(one("BIRT", "birth"), "rec", "left").join(one("DEAT", "death"), "rec", "left")
        cut = F.split(F.coalesce("full", F.lit("")), "/")
        at = lambda k: F.trim(F.coalesce(F.try_element_at(cut, F.lit(k)), F.lit("")))
        return j.select("id", F.coalesce("givn", at(1)).alias("given_name"), F.coalesce("surn", at(2)).alias("surname"), "sex", "birth_date", "birth_place", "death_date", "death_place", pointer(F.col("famc")).alias("family_as_child"), F.filter(F.transform("fams", pointer), lambda x: x.isNotNull()).alias("families_as_spouse"), "notes", "rec")

    def families(self) -> DataFrame:
        l = self._of("FAM")
        is1 = lambda tag: (F.col("level") == 1) & (F.col("tag") == tag)
        base = l.groupBy("rec", "id").agg(self._first(is1("HUSB"), "h"), self._first(is1("WIFE"), "w"), F.transform(F.sort_array(F.collect_list(F.when(is1("CHIL"), F.struct("pos", "value")))), lambda x: pointer(x["value"])).alias("children_ids"))
        marr = l.where(is1("MARR")).groupBy("rec").agg(F.min("pos").alias("m"))
        wed = l.where(F.col("level") == 2).join(marr, "rec").where(F.col("l1") == F.col("m")).groupBy("rec").agg(self._first(F.col("tag") == "DATE", "marriage_date"), self._first(F.col("tag") == "PLAC", "marriage_place"))
        return base.join(wed, "rec", "left").select("id", pointer(F.col("h")).alias("husband_id"), pointer(F.col("w")).alias("wife_id"), F.filter("children_ids", lambda x: x.isNotNull()).alias("children_ids"), "marriage_date", "marriage_place", "rec")

    def sources(self) -> DataFrame:
        s = self._level1(self._of("SOUR"), title="TITL", author="AUTH", publication="PUBL", repo="REPO", note="NOTE")
        return s.select("id", "title", "author", "publication", pointer(F.col("repo")).alias("repository_id"), "note", "rec")

    def repositories(self) -> DataFrame:
        return self._level1(self._of("REPO"), name="NAME", address="ADDR", url="WWW").drop("rec")


def _tagged(level: int, tag: str, value: Column) -> Column:
    """A line, its line breaks written as CONT lines; null for a null value."""
    breaks = F.regexp_replace(value, r"\r?\n", f"\n{level + 1} CONT ")
    return F.concat(F.lit(f"{level} {tag} "), breaks)


def render(individuals: DataFrame, families: DataFrame) -> DataFrame:
    """(value): the records of people and families as lineage text, one row a record."""
    i = individuals
    person = F.concat_ws(
        "\n", F.concat(F.lit("0 "), F.col("id"), F.lit(" INDI")), F.concat(F.lit("1 NAME "), F.col("given_name"), F.lit(" /"), F.col("surname"), F.lit("/")), _tagged(1, "SEX", F.col("sex")),
        F.when(F.col("birth_date").isNotNull() | F.col("birth_place").isNotNull(), F.concat_ws("\n", F.lit("1 BIRT"), _tagged(2, "DATE", F.col("birth_date")), _tagged(2, "PLAC", F.col("birth_place")))),
        F.when(F.col("death_date").isNotNull() | F.col("death_place").isNotNull(), F.concat_ws("\n", F.lit("1 DEAT"), _tagged(2, "DATE", F.col("death_date")), _tagged(2, "PLAC", F.col("death_place")))),
        _tagged(1, "FAMC", F.col("famc")), F.nullif(F.array_join(F.transform("fams", lambda x: F.concat(F.lit("1 FAMS "), x)), "\n"), F.lit("")),
        F.nullif(F.array_join(F.transform("notes", lambda x: _tagged(1, "NOTE", x)), "\n"), F.lit("")),
    )
    fam = F.concat_ws(
        "\n", F.concat(F.lit("0 "), F.col("family_id"), F.lit(" FAM")), _tagged(1, "HUSB", F.col("husband_id")), _tagged(1, "WIFE", F.col("wife_id")), F.nullif(F.array_join(F.transform("children_ids", lambda x: F.concat(F.lit("1 CHIL "), x)), "\n"), F.lit("")),
        F.when(F.col("marriage_date").isNotNull() | F.col("marriage_place").isNotNull(), F.concat_ws("\n", F.lit("1 MARR"), _tagged(2, "DATE", F.col("marriage_date")), _tagged(2, "PLAC", F.col("marriage_place")))),
    )
    return i.select(person.alias("value")).unionByName(families.select(fam.alias("value")))


def render_events(events: DataFrame, citations: DataFrame) -> DataFrame:
    """(value): a record for each person with its events in order, their notes, and the events' citations in order; an
    event whose citations name no source still has its lines."""
    under = F.concat_ws(
        "\n", _tagged(2, "SOUR", F.col("source_id")), _tagged(3, "PAGE", F.col("page")),
        F.when(F.col("text").isNotNull() | F.col("url").isNotNull(), F.concat_ws("\n", F.lit("3 DATA"), _tagged(4, "TEXT", F.col("text")), _tagged(4, "WWW", F.col("url")))),
    )
    in_order = lambda key: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, F.col("lines")))), lambda x: x["lines"]), "\n")
    cited = citations.where("source_id is not null").select(F.col("individual_id").alias("c_id"), F.col("event_ord").alias("c_ord"), "cite_ord", under.alias("lines"))
    cited = cited.groupBy("c_id", "c_ord").agg(in_order("cite_ord").alias("cited"))
    e = events.join(cited, (F.col("individual_id") == F.col("c_id")) & (F.col("event_ord") == F.col("c_ord")), "left")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("1 "), F.col("type")), F.when(F.col("type") == "EVEN", _tagged(2, "TYPE", F.col("description"))), _tagged(2, "DATE", F.col("date")), _tagged(2, "PLAC", F.col("place")),
        F.nullif(F.array_join(F.transform("notes", lambda x: _tagged(2, "NOTE", x)), "\n"), F.lit("")), "cited",
    )
    people = e.select("individual_id", "event_ord", lines.alias("lines")).groupBy("individual_id").agg(in_order("event_ord").alias("body"))
    return people.select(F.concat(F.lit("0 "), F.col("individual_id"), F.lit(" INDI\n"), F.col("body")).alias("value"))


def render_sources(sources: DataFrame, repositories: DataFrame) -> DataFrame:
    """(value): a record for each source and each repository."""
    record = lambda tag, **cols: F.concat_ws("\n", F.concat(F.lit("0 "), F.col("id"), F.lit(f" {tag}")), *[_tagged(1, t, F.col(c)) for t, c in cols.items()])
    of_sources = sources.select(record("SOUR", TITL="title", AUTH="author", PUBL="publication", REPO="repository_id", NOTE="note").alias("value"))
    return of_sources.unionByName(repositories.select(record("REPO", NAME="name", ADDR="address", WWW="url").alias("value")))
