"""One logical query, rendered for Spark or for the SQL engine that checks it: only spellings differ here."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from vocalith.operators.alignment import distances


class Spark:
    def __init__(self, sf_dir: str, session=None):
        self.sf_dir, self.session = sf_dir, session

    def _stamp(self) -> int:
        """A number that changes with the files of the folder: their names, sizes and times."""
        jvm, conf = self.session._jvm, self.session._jsparkSession.sessionState().newHadoopConf()
        folder = jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        files = folder.getFileSystem(conf).listStatus(folder)
        return zlib.crc32(repr(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)).encode())

    def once(self, name: str, sql: str) -> str:
        """``sql``, computed once for a session that asks for it from several queries: its rows stay with the executors, on disk where memory is short.

        Where the tables' files have changed since, the old rows are dropped and made anew.
        """
        if self.session is None:
            return sql
        own = f"{name}_{zlib.crc32((self.sf_dir + sql).encode())}"
        view, catalog = f"{own}_{self._stamp()}", self.session.catalog
        if not catalog.tableExists(view):
            for old in [t.name for t in catalog.listTables(pattern=f"{own}_*") if t.isTemporary]:
                catalog.uncacheTable(old)
                catalog.dropTempView(old)
            self.session.sql(sql).persist().createOrReplaceTempView(view)
        return f"SELECT * FROM {view}"

    def deal(self, sql: str, key: str) -> str:
        """``sql`` dealt over all tasks by ``key``, whatever row groups its file has: as many as the session shuffles to."""
        n = "" if self.session is None else f"{self.session.conf.get('spark.sql.shuffle.partitions')}, "
        return f"SELECT /*+ REPARTITION({n}{key}) */ * FROM ({sql}) dealt"

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    index = "i"  # of the element in a lambda, from 0
    size, join, distinct, position, concat_arrays = "size", "array_join", "array_distinct", "array_position", "concat"

    def distance(self, a: str, b: str, builtin: str) -> str:
        """The edit distance of two word arrays, by batches of them; ``builtin`` without a session, which the function is registered in."""
        if self.session is None:
            return builtin

        def word_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
            return distances(ref, hyp)

        self.session.udf.register("word_distance", F.arrow_udf(word_distance, "bigint"))
        return f"word_distance({a}, {b})"

    def words(self, a: str, b: str, builtin: str) -> str:
        """The edit distance of two word arrays with ``dict`` their different words, ``builtin`` being that of their codes."""
        return builtin

    def lit(self, pattern: str) -> str:
        return "r'" + pattern + "'"

    def lam(self, args: str, body: str) -> str:
        return f"({args}) -> {body}" if "," in args else f"{args} -> {body}"

    def transform(self, array: str, args: str, body: str) -> str:
        return f"transform({array}, {self.lam(args, body)})"

    def filter(self, array: str, args: str, body: str) -> str:
        return f"filter({array}, {self.lam(args, body)})"

    def explode(self, array: str) -> str:
        return f"explode({array})"

    def sequence(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def at(self, array: str, n: str) -> str:
        return f"element_at({array}, {n})"

    def replace(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(by)})"

    def extract(self, s: str, pattern: str, group: int) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def extract_all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, 0)"

    def matches(self, s: str, pattern: str) -> str:
        return f"({s} rlike {self.lit(pattern)})"

    def split(self, s: str, pattern: str) -> str:
        return f"split({s}, {self.lit(pattern)})"

    def struct(self, **fields: str) -> str:
        return "struct(" + ", ".join(f"{v} AS {k}" for k, v in fields.items()) + ")"

    def hex_int(self, s: str, digits: int) -> str:
        return f"cast(conv(substr(md5({s}), 1, {digits}), 16, 10) AS BIGINT)"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def json_text(self, s: str, key: str) -> str:
        return f"get_json_object({s}, '$.{key}')"

    def infinity(self) -> str:
        return "cast('Infinity' AS DOUBLE)"

    def json_int(self, s: str, key: str) -> str:
        return f"cast(get_json_object({s}, '$.{key}') AS BIGINT)"

    def collect(self, x: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS x))), s -> s.x)"

    def array_sort(self, a: str) -> str:
        return f"array_sort({a})"

    def contains(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})"

    def last(self, x: str) -> str:
        return f"last_value({x}, true)"

    def us(self, ts: str) -> str:
        return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})"

    def char(self, n: str) -> str:
        """A character of its own for each n from 1 on: printable ASCII ones first, which are cheap, then those from U+4E5F on."""
        return f"CASE WHEN {n} < 95 THEN chr(32 + {n}) ELSE decode(unhex(lpad(hex(19968 + {n}), 4, '0')), 'UTF-16BE') END"


class Duck(Spark):
    def __init__(self):
        super().__init__("")

    def once(self, name: str, sql: str) -> str:
        return sql

    def deal(self, sql: str, key: str) -> str:
        return sql

    def distance(self, a: str, b: str, builtin: str) -> str:
        return builtin

    index = "(i - 1)"
    size, join, distinct, position, concat_arrays = "len", "array_to_string", "list_distinct", "list_position", "list_concat"

    def table(self, name: str) -> str:
        return name

    def lit(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def lam(self, args: str, body: str) -> str:
        return f"lambda {args}: {body}"

    def transform(self, array: str, args: str, body: str) -> str:
        return f"list_transform({array}, {self.lam(args, body)})"

    def filter(self, array: str, args: str, body: str) -> str:
        return f"list_filter({array}, {self.lam(args, body)})"

    def explode(self, array: str) -> str:
        return f"unnest({array})"

    def sequence(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def at(self, array: str, n: str) -> str:
        return f"({array})[{n}]"

    def replace(self, s: str, pattern: str, by: str) -> str:
        by = by.replace("$1", "\\1").replace("$2", "\\2")
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def extract_all(self, s: str, pattern: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)})"

    def matches(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def split(self, s: str, pattern: str) -> str:
        return f"string_split_regex({s}, {self.lit(pattern)})"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def hex_int(self, s: str, digits: int) -> str:
        return f"('0x' || substr(md5({s}), 1, {digits}))::BIGINT"

    def sha256(self, s: str) -> str:
        return f"sha256({s})"

    def json_text(self, s: str, key: str) -> str:
        return f"json_extract_string({s}, '$.{key}')"

    def json_int(self, s: str, key: str) -> str:
        return f"cast(json_extract_string({s}, '$.{key}') AS BIGINT)"

    def collect(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order})"

    def array_sort(self, a: str) -> str:
        return f"list_sort({a})"

    def contains(self, array: str, x: str) -> str:
        return f"list_contains({array}, {x})"

    def last(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"

    def us(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def char(self, n: str) -> str:
        return f"chr(cast(32 + {n} AS INT))"


class DuckWords(Duck):
    """As ``Duck``, with edit distances of words for pairs of any number of different words.

    ``levenshtein`` counts bytes, so it holds while each word's character is one byte; beyond that the rows of the table are made one by one.
    """

    def words(self, a: str, b: str, builtin: str) -> str:
        """The distance of ``a`` and ``b``, whose different words are ``dict``."""
        at = lambda x: f"list_transform({x}, lambda x: list_position(dict, x))"
        step = "list_transform(range(1, len(acc) + 1), lambda j: least(acc[j] + 1, CASE WHEN j > 1 THEN acc[j - 1] + CASE WHEN r[j - 1] = w[1] THEN 0 ELSE 1 END END) - j)"
        row = f"list_transform([{step}], lambda t: list_transform(t, lambda x, j: j + list_min(t[1:j])))[1]"
        table = f"list_transform([{at(a)}], lambda r: list_reduce(list_transform({b}, lambda x: [cast(list_position(dict, x) AS BIGINT)]), lambda acc, w: {row}, range(0, len(r) + 1))[-1])[1]"
        return f"CASE WHEN len(dict) <= 94 THEN {builtin} ELSE cast({table} AS BIGINT) END"
