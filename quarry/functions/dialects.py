"""Five SQL dialects: quoting, features, types, reserved words, limit syntax."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The public dialects' features, types and words.
FEATURES = ("CTE", "WINDOW_FUNCTIONS", "JSON", "ARRAY", "RECURSIVE_CTE", "PARTITIONING", "FULL_TEXT_SEARCH", "XML", "UPSERT", "RETURNING")
COMMON_TYPES = "INT INTEGER BIGINT SMALLINT TINYINT DECIMAL NUMERIC FLOAT REAL DOUBLE VARCHAR CHAR TEXT NVARCHAR NCHAR DATE TIME DATETIME TIMESTAMP BOOLEAN BOOL BIT BLOB BINARY VARBINARY".split()
COMMON_RESERVED = "ALL AND AS ASC BETWEEN BY CASE CHECK COLUMN CONSTRAINT CREATE CROSS DEFAULT DELETE DESC DISTINCT DROP ELSE END EXISTS FOREIGN FROM FULL GROUP HAVING IN INDEX INNER INSERT INTO IS JOIN KEY LEFT LIKE LIMIT NOT NULL ON OR ORDER OUTER PRIMARY REFERENCES RIGHT SELECT SET TABLE THEN UNION UNIQUE UPDATE USING VALUES VIEW WHEN WHERE WITH".split()

#: MySQL's words besides the common ones, and all words of PostgreSQL.
_MYSQL_RESERVED = """
    ADD ALTER ANALYZE ASENSITIVE BEFORE BIGINT BINARY BLOB BOTH CALL CASCADE CHANGE CHAR CHARACTER COLLATE CONDITION
    CONTINUE CONVERT CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP CURRENT_USER CURSOR DATABASE DATABASES DAY_HOUR
    DAY_MICROSECOND DAY_MINUTE DAY_SECOND DEC DECIMAL DECLARE DELAYED DESCRIBE DETERMINISTIC DISTINCTROW DIV DOUBLE DUAL
    EACH ELSEIF ENCLOSED ESCAPED EXIT EXPLAIN FALSE FETCH FLOAT FLOAT4 FLOAT8 FOR FORCE FULLTEXT GRANT HIGH_PRIORITY
    HOUR_MICROSECOND HOUR_MINUTE HOUR_SECOND IF IGNORE INFILE INOUT INSENSITIVE INT INT1 INT2 INT3 INT4 INT8 INTEGER
    INTERVAL ITERATE KEYS KILL LEADING LEAVE LINEAR LINES LOAD LOCALTIME LOCALTIMESTAMP LOCK LONG LONGBLOB LONGTEXT LOOP
    LOW_PRIORITY MATCH MEDIUMBLOB MEDIUMINT MEDIUMTEXT MIDDLEINT MINUTE_MICROSECOND MINUTE_SECOND MOD MODIFIES NATURAL
    NO_WRITE_TO_BINLOG NUMERIC OPTIMIZE OPTION OPTIONALLY OUT OUTFILE PRECISION PROCEDURE PURGE RANGE READ READS REAL
    REGEXP RELEASE RENAME REPEAT REPLACE REQUIRE RESTRICT RETURN REVOKE RLIKE SCHEMA SCHEMAS SECOND_MICROSECOND SENSITIVE
    SEPARATOR SHOW SMALLINT SPATIAL SPECIFIC SQL SQLEXCEPTION SQLSTATE SQLWARNING SQL_BIG_RESULT SQL_CALC_FOUND_ROWS
    SQL_SMALL_RESULT SSL STARTING STRAIGHT_JOIN TERMINATED TINYBLOB TINYINT TINYTEXT TO TRAILING TRIGGER TRUE UNDO UNLOCK
    UNSIGNED USAGE USE UTC_DATE UTC_TIME UTC_TIMESTAMP VARBINARY VARCHAR VARCHARACTER VARYING WHILE WRITE X509 XOR
    YEAR_MONTH ZEROFILL
"""
_POSTGRESQL_RESERVED = """
    ALL ANALYSE ANALYZE AND ANY ARRAY AS ASC ASYMMETRIC AUTHORIZATION BINARY BOTH CASE CAST CHECK COLLATE COLLATION COLUMN
    CONCURRENTLY CONSTRAINT CREATE CROSS CURRENT_CATALOG CURRENT_DATE CURRENT_ROLE CURRENT_SCHEMA CURRENT_TIME
    CURRENT_TIMESTAMP CURRENT_USER DEFAULT DEFERRABLE DESC DISTINCT DO ELSE END EXCEPT FALSE FETCH FOR FOREIGN FREEZE FROM
    FULL GRANT GROUP HAVING ILIKE IN INITIALLY INNER INTERSECT INTO IS ISNULL JOIN LATERAL LEADING LEFT LIKE LIMIT
    LOCALTIME LOCALTIMESTAMP NATURAL NOT NOTNULL NULL OFFSET ON ONLY OR ORDER OUTER OVERLAPS PLACING PRIMARY REFERENCES
    RETURNING RIGHT SELECT SESSION_USER SIMILAR SOME SYMMETRIC TABLE TABLESAMPLE THEN TO TRAILING TRUE UNION UNIQUE USER
    USING VARIADIC VERBOSE WHEN WHERE WINDOW WITH
"""

@dataclass(frozen=True)
class Dialect:
    name: str
    open: str
    close: str
    features: frozenset[str]
    types: tuple[str, ...]
    reserved: frozenset[str]
    limit: str  # Standard, SQLServer or Oracle
    double_quoted_strings: bool = False
    backslash_escapes: bool = False
    dollar_quotes: bool = False

    def quote(self, name: str) -> str:
        return f"{self.open}{name.replace(self.close, self.close * 2)}{self.close}"

    def is_reserved(self, word: str) -> bool:
        return word.upper() in self.reserved


def _make(name: str, quotes: str, features: str, types: str, reserved: str, limit: str = "Standard", base: Sequence[str] = COMMON_RESERVED, **kw: bool) -> Dialect:
    return Dialect(name, quotes[0], quotes[1], frozenset(features.split()), tuple(dict.fromkeys([*COMMON_TYPES, *types.split(",")])), frozenset([*base, *reserved.split()]), limit, **kw)


_BASIC = "CTE WINDOW_FUNCTIONS JSON"
DIALECTS = {
    "mysql": _make("MySQL", "``", f"{_BASIC} RECURSIVE_CTE FULL_TEXT_SEARCH UPSERT", "MEDIUMINT,ENUM,SET,TINYTEXT,MEDIUMTEXT,LONGTEXT,TINYBLOB,MEDIUMBLOB,LONGBLOB,YEAR,JSON,GEOMETRY,POINT,LINESTRING,POLYGON", _MYSQL_RESERVED, base=[w for w in COMMON_RESERVED if w not in ("END", "FULL", "VIEW")], double_quoted_strings=True, backslash_escapes=True),
    "postgresql": _make("PostgreSQL", '""', f"{_BASIC} ARRAY RECURSIVE_CTE PARTITIONING FULL_TEXT_SEARCH XML UPSERT RETURNING", "SERIAL,BIGSERIAL,SMALLSERIAL,BYTEA,INET,CIDR,MACADDR,MACADDR8,UUID,XML,JSON,JSONB,ARRAY,HSTORE,LTREE,CUBE,ISN,TSQUERY,TSVECTOR,TXID_SNAPSHOT,INT4RANGE,INT8RANGE,NUMRANGE,TSRANGE,TSTZRANGE,DATERANGE,MONEY,PG_LSN,PG_SNAPSHOT,INTERVAL,TIME WITH TIME ZONE,TIMESTAMP WITH TIME ZONE,POINT,LINE,LSEG,BOX,PATH,POLYGON,CIRCLE", _POSTGRESQL_RESERVED, base=(), dollar_quotes=True),
    "sqlserver": _make("SQL Server", "[]", f"{_BASIC} XML UPSERT", "UNIQUEIDENTIFIER,MONEY,SMALLMONEY,DATETIME2,DATETIMEOFFSET,SMALLDATETIME,NTEXT,IMAGE,HIERARCHYID,GEOGRAPHY,GEOMETRY,SQL_VARIANT", "APPLY DELETED FETCH IDENTITY INSERTED MATCHED MERGE NEXT NOLOCK NTEXT OFFSET ONLY OUTPUT PAGLOCK PIVOT ROWLOCK ROWS SERIALIZABLE TABLOCK TOP UNPIVOT UPDLOCK XLOCK", "SQLServer"),
    "sqlite": _make("SQLite", '""', f"{_BASIC} RECURSIVE_CTE FULL_TEXT_SEARCH UPSERT", "NONE", "ABORT ANALYZE ATTACH AUTOINCREMENT CONFLICT DETACH FAIL GENERATED GLOB IGNORE ISNULL MATCH NOTNULL PRAGMA REGEXP REPLACE ROLLBACK ROWID STORED STRICT TEMP TEMPORARY VACUUM VIRTUAL WITHOUT"),
    "oracle": _make("Oracle", '""', "CTE WINDOW_FUNCTIONS RECURSIVE_CTE PARTITIONING FULL_TEXT_SEARCH XML", "NUMBER,VARCHAR2,NVARCHAR2,CLOB,NCLOB,LONG,LONG RAW,RAW,ROWID,UROWID,TIMESTAMP WITH TIME ZONE,TIMESTAMP WITH LOCAL TIME ZONE,INTERVAL YEAR TO MONTH,INTERVAL DAY TO SECOND,XMLTYPE,URITYPE,BFILE,BINARY_FLOAT,BINARY_DOUBLE", "CACHE COMPRESS CONNECT DEFERRABLE DISABLE DUAL ENABLE FLASHBACK LOGGING NOCYCLE NOLOGGING PARALLEL PARTITION PIVOT PRIOR PURGE ROWID ROWNUM SIBLINGS START SYSDATE SYSTIMESTAMP UNPIVOT XMLELEMENT", "Oracle"),
}
ALIASES = {"postgres": "postgresql", "mssql": "sqlserver"}
DEFAULT = "sqlserver"

#: Spark types for declared type names; unknown names map to string.
SPARK_TYPES = {
    "TINYINT": "tinyint", "SMALLINT": "smallint", "INT": "int", "INTEGER": "int", "MEDIUMINT": "int", "YEAR": "int", "BIGINT": "bigint", "SERIAL": "bigint", "BIGSERIAL": "bigint", "LONG": "bigint", "FLOAT": "float", "REAL": "float", "BINARY_FLOAT": "float", "DOUBLE": "double", "BINARY_DOUBLE": "double",
    "DATE": "date", "DATETIME": "timestamp", "DATETIME2": "timestamp_ntz", "DATETIMEOFFSET": "timestamp", "SMALLDATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp", "BOOLEAN": "boolean", "BOOL": "boolean", "BIT": "boolean", "BLOB": "binary", "BINARY": "binary", "VARBINARY": "binary", "BYTEA": "binary", "IMAGE": "binary", "RAW": "binary",
    "INTERVAL": "interval day to second", "INTERVAL DAY TO SECOND": "interval day to second", "INTERVAL YEAR TO MONTH": "interval year to month", "HSTORE": "map<string,string>", "ARRAY": "array<string>", "SET": "array<string>",
}
TYPE_GROUPS = {t: g for g, ts in {"numeric": "INT INTEGER BIGINT SMALLINT TINYINT DECIMAL NUMERIC FLOAT DOUBLE REAL", "string": "VARCHAR CHAR TEXT NVARCHAR NCHAR", "datetime": "DATE TIME DATETIME TIMESTAMP"}.items() for t in ts.split()}


def get(name: str | None) -> Dialect:
    """By name or alias, in any case; SQL Server if unknown."""
    key = (name or "").lower()
    return DIALECTS.get(ALIASES.get(key, key), DIALECTS[DEFAULT])


def reserved_words(spark: SparkSession) -> DataFrame:
    """(dialect, word) of every reserved word, for semi-joins with names."""
    return spark.createDataFrame([(k, w) for k, d in DIALECTS.items() for w in sorted(d.reserved)], "dialect string, word string")


def spark_type(name: str, length: int | None = None, precision: int | None = None, scale: int | None = None) -> str:
    n = name.upper()
    if n in ("VARCHAR", "CHAR") and length:
        return f"{n.lower()}({length})"
    if n in ("DECIMAL", "NUMERIC", "NUMBER"):
        return f"decimal({min(precision or 38 if n == 'NUMBER' else precision or 10, 38)},{scale or 0})"
    if n in ("MONEY", "SMALLMONEY"):
        return "decimal(19,4)"
    return SPARK_TYPES.get(n, "string")


def compatible(a: str, b: str) -> bool:
    a, b = a.upper(), b.upper()
    return a == b or (a in TYPE_GROUPS and TYPE_GROUPS[a] == TYPE_GROUPS.get(b))


def feature_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f, f in d.features) for k, d in DIALECTS.items() for f in FEATURES], "dialect string, feature string, supported boolean")


def type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t, TYPE_GROUPS.get(t), spark_type(t)) for k, d in DIALECTS.items() for t in d.types], "dialect string, type string, type_group string, spark_type string")


def quoted(name: Column, dialect: Column) -> Column:
    """Quoting as a column expression."""
    out = F.lit(None).cast("string")
    for k, d in DIALECTS.items():
        out = F.when(dialect == k, F.concat(F.lit(d.open), F.replace(name, F.lit(d.close), F.lit(d.close * 2)), F.lit(d.close))).otherwise(out)
    return out
