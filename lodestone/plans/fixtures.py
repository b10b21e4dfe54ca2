"""Source files and trees written out by hand, with what they hold, for queries over extraction and resolution.

A case is repeated for each supplier: ``§`` in paths, sources and names stands
for the supplier's key, so the cases grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fact = tuple[str, str]

#: Name: (file below the case's folder, source, facts).
SOURCES: dict[str, tuple[str, str, list[Fact]]] = {
    "python imports": (
        "a.py",
        "import os§, sys as system\n"
        "from pathlib import Path, PurePath as PP\n"
        "from ..pkg§ import thing, other as alias\n"
        "from . import near\n"
        "from star§ import *\n"
        "try:\n    import deep.down§.below\nexcept ImportError: import spare\n"
        '"""\nimport quoted\n"""\n# import remarked\n',
        [("import", n) for n in ("os§", "sys", "pathlib", "Path", "..pkg§", "thing", "..other", ".", "near", "star§", "deep.down§.below", "spare")],
    ),
    "python symbols": (
        "b.py",
        "class Shape§:\n"
        "    def area§(self):\n"
        "        def inner():\n"
        "            pass\n"
        "        return self.side.value§(json.dumps(1))\n"
        "    def _hidden(self): pass\n"
        "    def __repr__(self): pass\n"
        "class _Private§(Shape§):\n    pass\n"
        "async def fetch§():\n    pass\n"
        "if True:\n    def branch§():\n        pass\n"
        "def outer§():\n    @decorate\n    def wrapped§():\n        pass\n",
        [("function", n) for n in ("area§", "__repr__", "fetch§", "branch§", "outer§", "wrapped§")]
        + [("container", n) for n in ("Shape§", "_Private§")]
        + [("reference", n) for n in ("self.side", "self.side.value§", "self.side.value§(json.dumps(1))", "json.dumps", "json.dumps(1)")],
    ),
    "rust uses": (
        "c.rs",
        "use std::collections::HashMap;\n"
        "use crate::core§::{model, util::{a, b as c}, self, d as e, other::*};\n"
        "use super::sib§;\n"
        "use outer§::thing as renamed;\n"
        "use plain§ as short;\n"
        "use glob::*;\nuse bare§;\nuse {one, two};\n"
        "use super::{lost§};\n"
        "mod child§;\n"
        "mod inline { fn inside§() {} }\n"
        '// use no::remark;\nconst T: &str = "use no::text;";\n',
        [("import", n) for n in ("std::collections::HashMap", "outer§::thing", "plain§", "lost§")]
        + [("import_local", n) for n in ("crate::core§::model", "crate::core§::util::a", "super::sib§", "child§")]
        + [("function", "inside§")]
        + [("reference", n) for n in ("std::collections", "std::collections::HashMap", "crate::core§", "super::sib§", "outer§::thing")],
    ),
    "rust items": (
        "mine§.rs",
        "use mine§::own;\n"
        "pub struct Point§<T> { x: T }\n"
        "enum Kind§ { A, B }\n"
        "trait Draw§ { fn sketch§(&self); }\n"
        "impl Draw§ for Point§ { fn sketch§(&self) {} }\n"
        "impl<T> Point§<T> { fn make§() -> Self { helper::build§() } }\n"
        "impl Display for u32 { fn show§(&self) {} }\n"
        'macro_rules! skip { () => { fn never§() {} } }\nfn last§() { println!("{}", never::this); }\n',
        [("import_local", "mine§::own")]
        + [("function", n) for n in ("sketch§", "make§", "show§", "last§")]
        + [("container", n) for n in ("Point§", "Kind§", "Draw§", "Display")]
        + [("reference", n) for n in ("mine§::own", "helper::build§")],
    ),
    "typescript": (
        "d.ts",
        'import React from "react§";\n'
        'import "./side§";\n'
        "import type { T } from '../types§';\n"
        'export { x } from "./re§";\n'
        'export * as ns from "lib§";\n'
        "// import z from './no§'\n"
        "export const a§ = (v: number): number => v, b§ = async x => x;\n"
        "let c§ = () => { const d§ = () => 1; return d§; };\n"
        "var no§ = () => 1;\n"
        "const fe§ = function () { return 1; };\n"
        "export default function top§<T>(x: T): T { if (x) { return x; } return call(x); }\n"
        "class Shape§ extends Base { static make§(): void { call(); } get size§() { return 1; } }\n"
        "interface Like§ { run(): void }\n"
        "export enum Color§ { Red }\n"
        "type Alias§ = string | number;\n",
        [("import", n) for n in ("react§", "lib§")]
        + [("import_local", n) for n in ("./side§", "../types§", "./re§")]
        + [("function", n) for n in ("a§", "b§", "c§", "d§", "top§", "make§", "size§")]
        + [("container", n) for n in ("Shape§", "Like§", "Color§", "Alias§")],
    ),
    "cpp": (
        "e.cpp",
        "#include <vector>\n"
        '#include "local§.h"\n'
        "#if defined(X)\n"
        '#include "cond§.hpp"\n'
        "#else\n"
        "#  include <other§>\n"
        "#endif\n"
        "#include MACRO\n"
        '// #include "remarked.h"\n'
        "int add§(int a) { return a; }\n"
        "static void run§() { call(); }\n"
        "int *ptr§() { return 0; }\n"
        "int Shape§::area() { return 1; }\n"
        "class Shape§ { int area() { return 1; } };\n"
        "struct Point§ { int x; };\n"
        "int declared§(int);\n",
        [("import", n) for n in ("vector", "other§")] + [("import_local", n) for n in ("local§.h", "cond§.hpp")] + [("function", n) for n in ("add§", "run§")] + [("container", n) for n in ("Shape§", "Point§")],
    ),
}

MACRO_SOURCE = 'BOOST_INCLUDE("m§.h")\nQ_INCLUDE(<n§.h>)\nplain("x§.h")\nINCLUDE "no§.h"\n'
MACRO_FACTS: list[Fact] = [("import_local", "m§.h"), ("import", "n§.h")]

#: Local and other imports of one Python file among its neighbours: (path, is_local).
NEIGHBOURS = {"pkg/a.py": "import near\nimport deep.x\nimport x.near\nfrom ..up§ import q\nimport os§\nfrom .. import near\n", "pkg/near.py": "", "pkg/deep/__init__.py": ""}
NEIGHBOUR_IMPORTS = [("near", True), ("deep.x", True), ("x.near", True), ("up§", True), ("q", False), ("os§", False), ("", True)]

#: A tree in four languages, the files that are no nodes (an ignore rule leaves them out), and all its edges.
TREE = {
    "lib.rs": "mod utils;\nmod api;\nuse crate::api::routes;\nuse crate::api::routes::Item;\nuse super::utils;\nfn g() { api::deep::run(); }\n",
    "main.rs": "use self::utils;\nmod gone;\n",
    "utils.rs": "",
    "api/mod.rs": "mod routes;\nmod deep;\n",
    "api/routes.rs": "use super::deep;\nuse super::super::utils;\nuse self::helper;\nuse routes::sub;\nuse super::super::super::utils;\n",
    "api/routes/sub.rs": "",
    "api/deep.rs": "",
    "api/helper.rs": "",
    "main.py": "import utils\nimport pack.mod\nfrom pack import thing\nimport os\n",
    "utils.py": "",
    "pack/__init__.py": "",
    "pack/mod.py": "from . import sib\nfrom ..utils import x\nfrom .sib import y\n",
    "pack/sib.py": "",
    "ui/app.ts": "import a from './button';\nimport '../shared';\nimport './theme.dark';\nimport 'react';\nimport './none';\n",
    "ui/button.ts": "",
    "ui/theme.ts": "",
    "shared/index.ts": "",
    "core/src/main.cpp": '#include "near.h"\n#include "top"\n#include "pub.h"\n#include "up.h"\n#include "vector"\n#include "gone.h"\n#include "hidden.h"\n#include "main.cpp"\n#include <near.h>\n',
    "core/src/near.h": "",
    "core/up.h": "",
    "top.hpp": "",
    "include/pub.h": "",
    "vector": "",
}
NOT_NODES = {"hidden.h": ""}
EDGES = [
    ("lib.rs", "utils.rs"), ("lib.rs", "api/mod.rs"), ("lib.rs", "api/routes.rs"), ("lib.rs", "api/deep.rs"),
    ("api/mod.rs", "api/routes.rs"), ("api/mod.rs", "api/deep.rs"),
    ("api/routes.rs", "api/deep.rs"), ("api/routes.rs", "utils.rs"), ("api/routes.rs", "api/helper.rs"), ("api/routes.rs", "api/routes/sub.rs"),
    ("main.py", "utils.py"), ("main.py", "pack/mod.py"), ("main.py", "pack/__init__.py"),
    ("pack/mod.py", "pack/__init__.py"), ("pack/mod.py", "utils.py"), ("pack/mod.py", "pack/sib.py"),
    ("ui/app.ts", "ui/button.ts"), ("ui/app.ts", "shared/index.ts"), ("ui/app.ts", "ui/theme.ts"),
    ("core/src/main.cpp", "core/src/near.h"), ("core/src/main.cpp", "top.hpp"), ("core/src/main.cpp", "include/pub.h"), ("core/src/main.cpp", "core/up.h"), ("core/src/main.cpp", "hidden.h"),
]

#: A tree with ignore rules: file: (bytes, is it a node).
RULED = {
    ".gitignore": (b"*.log.py\n/build/\n!keep.log.py\nsub/deep/\n", False),
    "a.py": (b"import os\n", True),
    "x.log.py": (b"", False),
    "keep.log.py": (b"x = 1\n\n", True),
    "build/made.py": (b"", False),
    "sub/build/made.rs": (b"fn f() {}", True),
    "sub/.ignore": (b"left.ts\n", False),
    "sub/left.ts": (b"", False),
    "sub/right.ts": (b"let a = 1;", True),
    "sub/deep/more.py": (b"", False),
    "bad.cpp": (b"int a;\xff\xfe", False),
    "notes.txt": (b"no source", False),
    ".hidden.py": (b"", False),
    ".cache/c.py": (b"", False),
}


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("i"))


def numbered(text: str) -> Column:
    """A text with the supplier's key in place of each ``§``."""
    return F.replace(F.lit(text), F.lit("§"), F.col("i"))


def files_of(rows: DataFrame, root: str, contents: dict[str, str], nodes: bool = True) -> DataFrame:
    """files(path, content, is_node) of a tree for each key, under ``root`` and the key."""
    cases = F.array(*[F.struct(F.concat(F.lit(f"{root}"), F.col("i"), F.lit("/"), numbered(name)).alias("path"), numbered(text).alias("content"), F.lit(nodes).alias("is_node")) for name, text in contents.items()])
    return rows.select(F.explode(cases).alias("f")).select("f.path", "f.content", "f.is_node")


def sql_rows(columns: str, rows: list[tuple]) -> str:
    show = lambda x: "NULL" if x is None else ("TRUE" if x else "FALSE") if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({columns})"


def sql_numbered(columns: str, rows: list[tuple]) -> str:
    """The rows for each supplier, ``§`` replaced in texts."""
    names = columns.split(", ")
    shown = [f"replace(t.{n}, '§', s_suppkey::VARCHAR) AS {n}" if isinstance(rows[0][k], str) else f"t.{n}" for k, n in enumerate(names)]
    return f"SELECT {', '.join(shown)} FROM supplier, {sql_rows(columns, rows)}"
