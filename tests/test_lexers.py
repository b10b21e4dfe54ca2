from lodestone.operators import lexers


def of(language, code, path="/p/x.py"):
    out = {}
    for kind, name in lexers.facts(language, path, code):
        out.setdefault(kind, set()).add(name)
    return out


def test_python_imports():
    got = of("Python", "import os\nimport sys as s, a.b.c\nfrom pathlib import Path\nfrom datetime import (datetime,\n   timedelta as td)\nfrom . import local_module\nfrom ..parent import name as pm\nfrom x import *\ntry: import inline\nexcept E: pass\n'''\nimport quoted\n'''\n# import comment\n")
    assert got["import"] == {"os", "sys", "a.b.c", "pathlib", "Path", "datetime", ".", "local_module", "..parent", "..name", "x", "inline"}


def test_python_alias_takes_last_name():
    assert of("Python", "from m import a, b as c\n")["import"] == {"m", "a"}
    assert of("Python", "from m import b as c\n")["import"] == {"m"}


def test_python_functions_and_classes():
    code = """
class Outer:
    def outer_method(self):
        def local_function():
            pass
        class Inner:
            def inner_method(self): pass
        @deco
        def decorated(): pass
    def _private(self): pass
    def __init__(self): pass
async def public(): pass
if True:
    def cond(): pass
class _Hidden: pass
"""
    got = of("Python", code)
    assert got["function"] == {"outer_method", "inner_method", "decorated", "__init__", "public", "cond"}
    assert got["container"] == {"Outer", "Inner", "_Hidden"}


def test_python_references():
    got = of("Python", "import os.path\nx = os.path.join('a', f(1).b)\n_y.z()\n")["reference"]
    assert got == {"os.path", "os.path.join", "os.path.join('a', f(1).b)", "f(1)", "f(1).b"}


def test_rust_uses():
    code = "use std::collections::HashMap;\nuse crate::a::{b, c::d, e::{f, g::h}, self, i as j};\nuse super::{x, y};\nuse super::super::utils;\nuse a as b;\nuse q::r as t;\nuse glob::*;\nuse bare;\nuse {one, two};\n"
    got = of("Rust", code, "/p/foo.rs")
    assert got["import"] == {"std::collections::HashMap", "x", "y", "a", "q::r"}
    assert got["import_local"] == {"crate::a::b", "crate::a::c::d", "crate::a::e::f", "crate::a::e::g::h", "super::super::utils"}


def test_rust_items():
    code = "pub mod utils;\nmod inline { fn inner() {} }\n/* fn no() {} */ pub struct S<T> { a: T }\nenum E { A }\ntrait Tr { fn sig(&self); }\nimpl Tr for S {}\nimpl<T> S<T> { fn m(&self) { a::b(\"use c::d;\"); println!(\"{}\", e::f); } }\nimpl std::fmt::Display for E {}\n"
    got = of("Rust", code, "/p/foo.rs")
    assert got["import_local"] == {"utils"} and "import" not in got
    assert got["function"] == {"inner", "sig", "m"}
    assert got["container"] == {"S", "E", "Tr"}
    assert "a::b" in got["reference"] and "e::f" not in got["reference"]


def test_rust_own_stem_is_local():
    assert of("Rust", "use foo::bar;\n", "/p/foo.rs") == {"import_local": {"foo::bar"}, "reference": {"foo::bar"}}


def test_typescript():
    code = """import { a } from './a'; import b from "react";
import './side';
export { x } from '../y';
export * from "./all";
// import z from './no'
function a() { return 1 }
const b = (x: number) => x + 1;
let c = async y => { return y }, d = function () {};
var e = () => 1;
export class C { methodH(): void { if (x) { foo(); } } }
interface D { m(): void }
enum E { A }
type F = string;
enum G {}
"""
    got = of("TypeScript", code, "/p/x.ts")
    assert got["import"] == {"react"} and got["import_local"] == {"./a", "./side", "../y", "./all"}
    assert got["function"] == {"a", "b", "c", "methodH"}
    assert got["container"] == {"C", "D", "E", "F", "G"}
    assert "reference" not in got


def test_cpp():
    code = '#include <vector>\n#include "local.h"\n/* #include "no.h" */\n#ifdef X\n#  include "cond.h"\n#endif\nint add(int a, int b) { return a + b; }\nvoid* ptr() { return 0; }\nclass Foo { int method() { return 1; } };\nint Foo::out() { return 2; }\nint decl(int);\nenum class En { A };\n'
    got = of("Cpp", code, "/p/x.cpp")
    assert got["import"] == {"vector"} and got["import_local"] == {"local.h", "cond.h"}
    assert got["function"] == {"add"} and got["container"] == {"Foo", "En"}


def test_macro_includes():
    got = set(lexers.macro_include_facts('BOOST_INCLUDE("a.h")\nQ_INCLUDE(<b.h>)\nnothing("c.h")\n'))
    assert got == {("import_local", "a.h"), ("import", "b.h")}


def test_broken_texts_do_not_fail():
    for language in ("Python", "Rust", "TypeScript", "Cpp"):
        for code in ("", "((((", "}}}}", '"""', "'", "/*", "use ;", "import", "from", "def", "class", "fn", "\x00", "é" * 50, "{" * 500):
            lexers.facts(language, "/p/f", code)


def test_long_files_take_linear_time():
    import time

    code = {
        "TypeScript": "/* note */\nimport { a } from './a@';\nclass C@ { m(): void { call(x); } }\nconst f@ = (x) => { return g(x, [1, { a: 2 }]); };\nrun(function () { go(1, () => { on(); }); });\n",
        "Rust": "impl A@ for B { fn f@(&self) { println!(\"{}\", x); a::b@(); } }\n",
        "Python": "class C@:\n    def f@(self):\n        return self.a.b(c(1), [d.e])\n",
        "Cpp": "#include \"a@.h\"\nint f@(int a) { if (a) { return g(a); } return 1; }\n",
    }
    for language, unit in code.items():
        text = "".join(unit.replace("@", str(i)) for i in range(1_000_000 // len(unit)))
        began = time.process_time()
        found = lexers.facts(language, "/p/x", text)
        assert len(found) > 3000 and time.process_time() - began < 10, language


def test_typescript_names_that_begin_like_modifiers():
    got = of("TypeScript", "class A { asyncRun() { return 1 } async wait() { return 2 } getter() { return 3 } }\n")
    assert got["function"] == {"asyncRun", "wait", "getter"}
