"""Source files that nobody in the project wrote by hand.

Layout statistics with thresholds per language find files made by programs, minified files and bulk data:
longest and mean line, share of white space and of letters and digits, numeric literals, long encoded runs,
repetition of line shapes and identifiers that carry a counter. Copies of third-party code are laid out like any other
code, so they are found by layouts that several projects share: a profile of the ink, letters and digits of every line
below the head comment, confirmed by the hash of that code, since short files can be laid out alike by chance. What no
layout shows, a head comment or the folders that package managers use may tell.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schemas import flat
from tidemark.session import stored

#: Thresholds by extension; DEFAULT holds for those not listed.
#: long, mean: longest and mean line of so many characters; dense: white space below this share in a file with long lines;
#: packed, short: share of the text in lines of LONG_LINE characters or more, and lines below it at most, which plain code
#: with one long literal doesn't reach; only scripts and style sheets are ever minified;
#: numbers: numeric literals per 100 characters of code; counters: identifiers with a counter per line of code;
#: shapes: share of distinct line shapes; least: lines of code from which shapes count.
DEFAULT = {"long": 150, "dense": 0.12, "numbers": 2.6, "counters": 0.2, "shapes": 0.36, "least": 6, "mean": 100, "packed": 2.0, "short": 4}
SCRIPT = DEFAULT | {"packed": 0.6}
THRESHOLDS = {
    ".js": SCRIPT,
    ".ts": SCRIPT,
    ".css": SCRIPT | {"numbers": 100.0, "counters": 100.0},
    ".sql": DEFAULT | {"numbers": 3.3, "counters": 100.0, "shapes": 0.2},
    ".rs": DEFAULT | {"counters": 0.22},
    ".c": DEFAULT | {"numbers": 3.0},
}
EXTENSIONS = (".go", ".py", ".ts", ".js", ".java", ".rs", ".c", ".css", ".sql")

LONG_LINE = 150
#: A run of so many characters of an encoding's alphabet is data, as is a text with this share in runs of a line's length.
ENCODED_RUN = 120
ENCODED_LINE = 48
ENCODED_SHARE = 0.4
#: Code below the head comment counts as a copy from so many characters on.
LEAST_COPY = 120

#: Folders in which package managers and people keep other people's packages.
VENDOR_FOLDER = r"/(?:vendor|node_modules|bower_components|third_party|thirdparty|third-party|external|Pods|deps|contrib)/[^/]+/"

#: Own words by which a head comment says that a program wrote the file, among them the marks that code review tools look for.
MADE = r"(?i)\bauto-?generated\b|(?<!not )\bgenerated (?:by|from|with|using|code|file)\b|@generated|\bdo not (?:edit|modify)\b"
#: Own words by which a head comment names another origin.
FOREIGN = r"(?i)\bupstream\b|\bverbatim\b|\bredistribut(?:ion|ed)\b|\blicen[cs]ed separately\b|\bcopied from\b|\bvendored\b|\bthird[- ]party\b|\bimported from\b"
#: Head comment: the comment lines before the first line of code.
HEAD = re.compile(rb"(?:[ \t]*(?:(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|pragma|!?\[))|/?\*|--|<!--)[^\n]*)?\n)+")
LAYOUT = (
    "size bigint, lines bigint, max_line bigint, mean_line double, packed double, short_lines bigint, space double, alnum double, numbers double,"
    " encoded_run bigint, encoded double, code_lines bigint, shapes double, counters double, profile bigint"
)
LAYOUT_COLUMNS = tuple(x.split()[0] for x in LAYOUT.split(",") if "profile" not in x)
_CHUNK = 4 << 20


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]+", "/"), r"/(?:\./)+", "/")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT = _table(b"0123456789")
_LETTER = _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
_LETTER[128:] = True
_SPACE = _table(b" \t\n\f\v\r")
_ENCODED = _DIGIT | _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=-_")
#: Bytes as line shapes see them: letters alike, digits alike, blanks gone.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_LETTER] = ord("a")
_SHAPE[_DIGIT] = ord("0")


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring starts; the last start is the end."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]


def _largest(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.maximum.at(out, of, values)
    return out


def _runs(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last places of the runs of a mask; no run goes over a cut."""
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    cuts = cuts[cuts < len(mask)]
    begins[cuts] = mask[cuts]
    at = cuts[cuts > 0] - 1
    ends[at] = mask[at]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _measure(texts: list[bytes], heads: list[int] | None = None) -> dict[str, np.ndarray]:
    """The layout of each text; all texts are measured at once as one array of bytes. A line break ends every text.

    heads: lengths of the head comments, which the profile leaves out.
    """
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    cuts = np.concatenate(([0], ends))
    of_text = np.repeat(np.arange(n), np.diff(cuts))
    space, digit, letter = _SPACE[data], _DIGIT[data], _LETTER[data]
    breaks = np.flatnonzero(data == 10)
    lines = np.concatenate(([0], breaks + 1))  # starts of lines; the last is the end
    owner = of_text[breaks]
    length = np.diff(lines) - 1
    ink = _sums(~space, lines)
    # comment lines, told by their first visible characters
    seen = np.flatnonzero(~space)
    first = np.append(seen, len(data) - 1)[np.minimum(np.searchsorted(seen, lines[:-1]), len(seen))]
    one, two = data[first], data[np.minimum(first + 1, len(data) - 1)]
    hash_code = (one == 35) & np.isin(two, np.frombuffer(b"idep![", np.uint8))  # preprocessor and attribute lines are code
    quotes = ((one == 34) | (one == 39)) & (two == one)
    comment = ((one == 35) & ~hash_code) | ((one == 47) & ((two == 47) | (two == 42))) | (one == 42) | ((one == 45) & (two == 45)) | quotes
    code_line = (ink > 0) & ~comment
    in_code = np.repeat(code_line, np.diff(lines))
    # numeric literals and identifiers that end in a counter
    begin, end = _runs(digit, cuts)
    before = np.where(begin > 0, data[begin - 1], 10)
    after = data[np.minimum(end, len(data) - 1)]
    long = end - begin
    figure = lambda back: np.where(long >= back, data[np.maximum(end - back, 0)].astype(np.int64) - 48, 0)
    width = (long <= 3) & np.isin(figure(1) + 10 * figure(2) + 100 * figure(3), [8, 16, 32, 64, 128])  # as in u32 or int64
    ok = in_code[begin]
    literal = ok & ~_LETTER[before] & (before != 46)
    counter = ok & _LETTER[before] & (before < 128) & (before != 120) & ~width & ~(_LETTER[after] & (after != 95))
    # shapes: blanks dropped, runs of letters and of digits made one
    shape = _SHAPE[data]
    keep = ~space & in_code
    place = np.flatnonzero(keep)
    shape = shape[place]
    line_of = np.repeat(np.arange(len(breaks)), np.diff(lines))[place]
    new = np.ones(len(place), bool)
    new[1:] = (shape[1:] != shape[:-1]) | (line_of[1:] != line_of[:-1]) | ~np.isin(shape[1:], [97, 48])
    shape, line_of = shape[new].astype(np.uint64), line_of[new]
    start = np.searchsorted(line_of, np.arange(len(breaks)))
    place = np.arange(len(shape)) - start[line_of]
    mixed = (shape + np.uint64(1)) * _powers(int(place.max()) + 1 if len(place) else 1)[place]
    total = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
    bounds = np.append(start, len(shape))
    key = total[bounds[1:]] - total[bounds[:-1]]
    mine = owner[code_line]
    _, kept = np.unique((key[code_line] ^ (key[code_line] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mine.astype(np.uint64), return_index=True)
    distinct = np.bincount(mine[kept], minlength=n)
    run_begin, run_end = _runs(_ENCODED[data], cuts)
    run = run_end - run_begin
    encoded = np.bincount(of_text[run_begin], weights=np.where(run >= ENCODED_LINE, run, 0), minlength=n)
    size = np.diff(cuts) - 1
    code_lines = np.bincount(owner[code_line], minlength=n)
    code_size = np.bincount(owner, weights=np.where(code_line, length, 0), minlength=n)
    visible = np.bincount(owner[ink > 0], minlength=n)
    over = lambda a, b: a / np.maximum(b, 1)
    # the profile: what each line below the head comment holds, in order, in one number
    body = (ink > 0) & (lines[:-1] >= (cuts[:-1] + np.array(heads if heads else [0] * n, np.int64))[owner])
    place = np.cumsum(body) - 1
    first_line = np.searchsorted(owner[body], np.arange(n))
    what = _mixed(_mixed(_mixed(ink.astype(np.uint64)) + _sums(digit, lines).astype(np.uint64)) + _sums(letter, lines).astype(np.uint64))[body]
    terms = np.concatenate(([np.uint64(0)], np.cumsum(what * _powers(max(1, len(what)))[place[body] - first_line[owner[body]]], dtype=np.uint64)))
    bounds = np.append(first_line, len(what))
    return {
        "size": size,
        "lines": visible,
        "max_line": _largest(length, owner, n),
        "mean_line": over(size, visible),
        "packed": over(np.bincount(owner, weights=np.where(length >= LONG_LINE, length, 0), minlength=n), size),
        "short_lines": np.bincount(owner[(ink > 0) & (length < LONG_LINE)], minlength=n),
        "space": over(_sums(space, cuts) - 1, size),
        "alnum": over(_sums(digit | (letter & (data != 95)), cuts), size),
        "numbers": over(100 * np.bincount(of_text[begin[literal]], minlength=n), code_size),
        "encoded_run": _largest(run, of_text[run_begin], n),
        "encoded": over(encoded, size),
        "code_lines": code_lines,
        "shapes": over(distinct, code_lines),
        "counters": over(np.bincount(of_text[begin[counter]], minlength=n), code_lines),
        "profile": (terms[bounds[1:]] - terms[bounds[:-1]]).view(np.int64),
    }


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=4)
def _grown(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return _grown(1 << max(10, int(n - 1).bit_length()))[:n]


def layout(files: DataFrame, content: str = "content") -> DataFrame:
    """Statistics of the layout of ``content`` beside all other columns, whose names must differ from the added ones.

    Adds the columns of LAYOUT, ``head`` (the comment before the first line of code) and ``body_hash`` (of what
    follows it, without blanks; null below LEAST_COPY characters). Null content counts as empty: zeros.
    """
    others = [f for f in files.schema if f.name != content]

    def measure(batches):
        for batch in batches:
            texts = [(x or "").replace("\r\n", "\n").replace("\r", "\n").encode() + b"\n" for x in batch.column(content).to_pylist()]
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= _CHUNK):
                    size += len(texts[high])
                    high += 1
                part = texts[low:high]
                heads = [m.group() if (m := HEAD.match(t)) else b"" for t in part]
                bodies = [t[len(h) :].translate(None, b" \t\n\f\v") for t, h in zip(part, heads)]
                found = _measure(part, list(map(len, heads)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name).slice(low, high - low) for f in others]
                    + [pa.array(v) for v in found.values()]
                    + [
                        pa.array([h.decode(errors="replace") for h in heads], pa.string()),
                        pa.array([xxhash.xxh3_64_intdigest(b) - (1 << 63) if len(b) >= LEAST_COPY else None for b in bodies], pa.int64()),
                    ],
                    names=[f.name for f in others] + list(found) + ["head", "body_hash"],
                )
                low = high

    made = T.StructType(others + list(flat(LAYOUT)) + [T.StructField("head", T.StringType()), T.StructField("body_hash", T.LongType())])
    return files.mapInArrow(measure, made)


def _threshold(extension: Column, name: str) -> Column:
    chosen = F.lit(float(DEFAULT[name]))
    for ext, values in THRESHOLDS.items():
        chosen = F.when(extension == ext, F.lit(float(values[name]))).otherwise(chosen)
    return chosen


def classify(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per source file with ``kind``: generated, minified, data, vendored or handwritten.

    files: file_id, project_id, path, is_dir. contents: file_id, content. Files without a content row, with null or
    empty content count as handwritten (nothing in them was made by a program). Repeated file_ids give one row each.
    A path may mix separators. Directories and other extensions give no row; a null is_dir counts as false.
    """
    f = files.where(~F.coalesce("is_dir", F.lit(False))).select("file_id", "project_id", _clean(F.col("path")).alias("path"))
    f = f.withColumn("extension", F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).where(F.col("extension").isin(*EXTENSIONS))
    # contents are measured where they are read; text itself is never shuffled
    measured = layout(contents.select(F.col("file_id").alias("_id"), "content"))
    measured = measured.withColumns({"_made": F.col("head").rlike(MADE), "_foreign": F.col("head").rlike(FOREIGN)}).drop("head")
    # stored, since the copies and the result both need it: contents are read, measured and joined once
    df = stored(f.join(measured, f.file_id == measured._id, "left").drop("_id"), "layout")
    at = lambda name: F.col(name)
    limit = lambda name: _threshold(F.col("extension"), name)
    repeated = (at("code_lines") >= limit("least")) & (at("shapes") <= limit("shapes"))
    df = df.withColumns({
        "minified": (at("max_line") >= limit("long")) & (at("mean_line") >= limit("mean")) & (at("packed") >= limit("packed")) & (at("short_lines") <= limit("short")) & (at("space") < limit("dense")) & (at("encoded") < ENCODED_SHARE),
        "data": (at("encoded_run") >= ENCODED_RUN) | (at("encoded") >= ENCODED_SHARE) | ((at("numbers") >= limit("numbers")) & repeated & (at("counters") < limit("counters"))) | (at("numbers") >= 8),
        "generated": F.col("_made") | (repeated & (at("counters") >= limit("counters"))),
        "foreign": F.coalesce("_foreign", F.lit(False)) | F.col("path").rlike(VENDOR_FOLDER),
    }).drop("_made", "_foreign")
    # copies: a file of this layout and code stands in another project too, or one of them lies in a vendor folder or names its origin
    told = F.col("body_hash").isNotNull()
    copies = (
        df.where(told)
        .groupBy(F.col("profile").alias("_profile"), F.col("body_hash").alias("_copied"))
        .agg(F.min("project_id").alias("_a"), F.max("project_id").alias("_z"), F.max("foreign").alias("_f"))
        .where((F.col("_a") != F.col("_z")) | F.col("_f"))
        .select("_profile", "_copied")
    )
    # short files have no hash: they are left out of the join, where they would all meet
    joined = df.where(told).join(copies, F.expr("profile = _profile and body_hash = _copied"), "left").drop("_profile")
    df = joined.unionByName(df.where(~told).withColumn("_copied", F.lit(None).cast("bigint")))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = (
        F.when(no("minified"), "minified")
        .when(no("generated"), "generated")
        .when(no("data"), "data")
        .when(no("foreign") | F.col("_copied").isNotNull(), "vendored")
        .otherwise("handwritten")
    )
    return df.select("file_id", "project_id", "path", "extension", kind.alias("kind"), *LAYOUT_COLUMNS)


def found(files: DataFrame, contents: DataFrame) -> DataFrame:
    """file_id of every source file that isn't hand-written."""
    return classify(files, contents).where("kind <> 'handwritten'").select("file_id")
