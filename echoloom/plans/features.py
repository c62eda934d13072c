"""A generated project that uses every construct the renamer speaks of, and what it must become, in SQL.

Each row of ``part`` gives one file; ``§`` stands for the row's key.  In ``AFTER`` a name between
« and » stands for its new name, and ◊1 and ◊2 for the first two names that nothing in the project has.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from echoloom.plans.bindings import KEY, spread_parts

BEFORE = """# features
import os
import json, sys as system
import parts.base
from typing import Any as Anything
from parts.base import Root as Base
from shutil import copy

class Box_§[T](Base):
    size: int = 1

    def visit_Name(self, node: Anything, *rest, **more):
        local = node
        self.pair, self.other = 1, 2
        self.hits += 1
        return local.size, rest, more

    async def fetch_§(self, count=1):
        async for item in self.size:
            item.size = count
        return await self.fetch_§(count=count)

def build_§(first: Box_§, second, copy=None):
    global total
    box = Box_§(size=first, **second)
    text = f'{first.size} size {os.sep}'
    for index, each in enumerate([box]):
        each.size = index
    left, [right] = sorted(box)
    names = [b.size for b in list(box) if b.local]
    pick = lambda box, second: box.size + second.size
    for member in box.size:
        member.size += 1
    try:
        json.loads(text).size
    except ValueError as second:
        second.size
    match first:
        case Box_§(size=left):
            pass
    setattr(first, 'size', names)
    build_§(first=1, second=2)
    os.path.join(size=1)
    known: Box_§ = second
    known.size = system.size = Base.size
    return getattr(self, 'size', pick)
"""
AFTER = """import os as ◊1
import json as ◊2, sys as system
import parts.base
from typing import Any as Anything
from parts.base import Root as Base
from shutil import copy

class «Box_§»(«Base»):
    «size»: int = 1

    def «visit_Name»(«self», «node»: Anything, *«rest», **«more»):
        «local» = «node»
        «self».pair, «self».other = (1, 2)
        «self».hits += 1
        return («local».size, «rest», «more»)

    async def «fetch_§»(«self», «count»=1):
        async for «item» in «self».«size»:
            «item».«size» = «count»
        return await «self».«fetch_§»(«count»=«count»)

def «build_§»(«first»: «Box_§», «second», copy=None):
    global total
    «box» = «Box_§»(«size»=«first», **«second»)
    «text» = f'{«first».«size»} size {◊1.sep}'
    for «index», «each» in enumerate([«box»]):
        «each».size = «index»
    «left», [«right»] = sorted(«box»)
    «names» = [«b».«size» for «b» in list(«box») if «b».«local»]
    «pick» = lambda «box», «second»: «box».«size» + «second».«size»
    for «member» in «box».«size»:
        «member».«size» += 1
    try:
        ◊2.loads(«text»).«size»
    except ValueError as second:
        «second».«size»
    match «first»:
        case «Box_§»(size=left):
            pass
    setattr(«first», '«size»', «names»)
    «build_§»(«first»=1, «second»=2)
    ◊1.path.join(size=1)
    «known»: «Box_§» = «second»
    «known».«size» = system.size = «Base».size
    return getattr(«self», 'size', «pick»)
"""
COUNTS = (93, 10, 1)
PATH = f"'src/f' || {KEY} || '.py'"
EXTERNAL = ("Anything", "copy", "json", "os", "system")
ATTRIBUTE = ("fetch_§", "local", "size", "visit_Name")
#: ``copy`` is a parameter too, but external names are no candidates anywhere.
CANDIDATE = ("Base", "Box_§", "b", "box", "build_§", "count", "each", "fetch_§", "first", "index", "item", "known", "left", "local", "member", "more", "names", "node", "pick", "rest", "right", "second", "self", "size", "text", "visit_Name")
FACTS = [("external", x) for x in EXTERNAL] + [("attribute", x) for x in ATTRIBUTE] + [("candidate", x) for x in CANDIDATE] + [("class", "Box_§"), ("dynamic", "size")]


def _spelled(text: str) -> str:
    """SQL for a text in which § is the row's key."""
    return " || ".join(f"'{piece.replace(chr(39), chr(39) * 2)}'" for piece in text.split("§")).replace("' || '", f"' || {KEY} || '")


INDEX_SQL = " UNION ".join(f"SELECT '{c}' AS category, {_spelled(n)} AS name FROM part" for c, n in FACTS)
SOURCES = f"SELECT {PATH} AS file_path, {_spelled(BEFORE)} AS content FROM part"


def feature_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread_parts(spark, sf_dir)
    return spark.sql(SOURCES.replace("\n", "\\n").replace("''", "\\'"))


def after_sql(mapped: str, taken: str) -> str:
    """The files after renaming, of SQL for the rename map (symbol, new_name) and for all names in use (name)."""
    out, joins, names = [], [], {}
    for piece in re.split(r"(«[^»]*»|◊[12])", AFTER):
        if piece.startswith("«"):
            name = piece[1:-1]
            if "§" in name:
                names.setdefault(name, f"m{len(names)}")
                out.append(f"{names[name]}.new_name")
            else:
                out.append(f"(SELECT new_name FROM m WHERE symbol = '{name}')")
        elif piece.startswith("◊"):
            out.append(f"(SELECT s FROM aliases WHERE place = {piece[1]})")
        elif piece:
            out.append(_spelled(piece))
    for name, alias in names.items():
        joins.append(f"JOIN m AS {alias} ON {alias}.symbol = {_spelled(name)}")
    a, b, c = COUNTS
    return f"""
WITH RECURSIVE m AS ({mapped}), used AS (SELECT name FROM ({taken}) UNION SELECT symbol FROM m UNION SELECT new_name FROM m),
names AS (SELECT range AS id, range AS n, '' AS s FROM range(100000) UNION ALL SELECT id, n // 26 - 1, chr((97 + n % 26)::INTEGER) || s FROM names WHERE n >= 0),
aliases AS (SELECT s, row_number() OVER (ORDER BY id) AS place FROM names WHERE n < 0 AND s NOT IN (SELECT name FROM used))
SELECT {PATH} AS file_path, {' || '.join(out)} AS transformed_source, false AS unchanged, {a} AS symbols_renamed, {b} AS likely_local_rewrites, {c} AS dynamic_name_rewrites
FROM part {' '.join(joins)}"""
