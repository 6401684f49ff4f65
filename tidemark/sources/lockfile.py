"""Lockfiles as line tables: the span of each package's entry, and which ones a diff touches.

Entries come out of windows over lines: a header opens a section, a key opens an entry, the next
key or section closes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import closed_overlap

KEY = r"^  (?:'([^']+)'|([^ '][^:]*)):(?: |$)"
NPM_KEY = r'^\s*"([^"]*node_modules/[^"]+)"\s*:'


def lock_format(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name == "pnpm-lock.yaml", "pnpm").when(name == "package-lock.json", "npm")


def lock_lines(files: DataFrame) -> DataFrame:
    """(path, text) to (path, n, line), 1-based, of lockfiles only; a last empty line is none."""
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\n$", "")
    return files.where(lock_format(F.col("path")).isNotNull()).select("path", F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).withColumn("n", F.col("n").cast("long") + 1)


def lock_entries(files: DataFrame) -> DataFrame:
    """(path, text) to (path, start, end, package)."""
    rows = lock_lines(files).withColumn("format", lock_format(F.col("path")))
    w = Window.partitionBy("path").orderBy("n")
    section = F.when(F.col("line") == "---", "").when(F.col("line").rlike(r"^[A-Za-z0-9]*:"), F.regexp_extract("line", "^([A-Za-z0-9]*):", 1))
    pnpm = rows.where("format = 'pnpm'").withColumn("opens", section)
    pnpm = pnpm.withColumn("section", F.last("opens", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.when(F.col("section").isin("packages", "patchedDependencies") & F.col("opens").isNull() & F.col("line").rlike(KEY), F.concat(F.regexp_extract("line", KEY, 1), F.regexp_extract("line", KEY, 2)))
    pnpm = pnpm.withColumn("key", key)
    bare = F.regexp_replace(F.element_at(F.split("key", r"\("), 1), r"^['\"\s]+|['\"\s]+$", "")
    pnpm = pnpm.withColumn("package", F.regexp_replace(bare, r"(?<=.)@[^@]*$", "")).withColumn("edge", F.col("key").isNotNull() | F.col("opens").isNotNull())

    # an npm entry goes on until a line that is not empty stands at its own depth or above
    npm = rows.where("format = 'npm'").withColumn("key", F.when(F.col("line").rlike(NPM_KEY), F.regexp_extract("line", NPM_KEY, 1)))
    npm = npm.withColumn("package", F.regexp_extract("key", r"^.*node_modules/(.+)$", 1))
    shallow = (F.length("line") - F.length(F.ltrim("line")) <= 4) & (F.trim("line") != "")
    npm = npm.withColumn("edge", F.col("key").isNotNull() | shallow)

    both = pnpm.select("path", "n", "key", "package", "edge").unionByName(npm.select("path", "n", "key", "package", "edge"))
    last = F.max("n").over(Window.partitionBy("path"))
    both = both.withColumn("last", last).where("edge").withColumn("end", F.coalesce(F.lead("n").over(w) - 1, F.col("last")))
    return both.where("key is not null and package <> ''").select("path", F.col("n").alias("start"), "end", "package")


def changed_packages(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Packages whose entries a change touches, and a null package where a lockfile has no entry
    that could be read: then every package counts as changed.

    changes: (path, change, start, length); an opaque change touches every entry.
    """
    changes = changes.where("change <> 'deleted'").withColumn("format", lock_format(F.col("path"))).where("format is not null")
    entries = lock_entries(files).withColumnRenamed("start", "first").withColumnRenamed("end", "final")
    touched = changes.join(entries, "path").where(F.col("start").isNull() | closed_overlap(F.col("first"), F.col("final"), F.col("start"), F.col("length")))
    present = changes.join(files.select("path"), "path", "left_semi")
    unread = present.join(entries.select("path"), "path", "left_anti").select(F.lit(None).cast("string").alias("package"))
    return touched.select("package").unionByName(unread).distinct()
