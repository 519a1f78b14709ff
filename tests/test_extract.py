"""Declarations and references of small sources in five languages."""

from codeloom.jobs.extract import extract
from codeloom.jobs.ingest import description_tasks, resolve, walk
from codeloom.operators import metrics as mt
from codeloom.operators import neighbours as nb

JAVA = """package shop;
import java.util.List;
import static java.lang.Math.*;

/* a class
   with class Fake in a comment { */
public abstract class Cart extends Base implements Sized, Closeable {
    private static final int MAX = 10;
    static int count;
    protected List<String> items = new ArrayList<>();
    public Cart(int n) {
        super(n);
        this.fill(n);
    }
    public int size() throws IOException {
        String s = "class Nope {";
        return helper(items.size());
    }
    abstract void empty();
    static class Inner {
        private void deep() { }
    }
    private int helper(int n) {
        if (n > 0) {
            new Inner();
        }
        return n;
    }
}
interface Sized {
    int size();
}
enum Kind { A, B }
"""
PYTHON = """import os
from a.b import c
LIMIT = 3
name = "x"

class Shop(Base, metaclass=M):
    total: int = 0

    def __init__(self):
        self.run()

    async def run(self) -> Result:
        await fetch(1)
        return os.path.join("a")

def _hidden():
    pass
"""
GO = """package shop

import "fmt"

type Store struct {
	name string
}

type Reader interface {
	Read() error
}

func NewStore(n string) *Store {
	return &Store{name: n}
}

func (s *Store) Save() error {
	fmt.Println(s.name)
	return validate(s)
}
"""
RUST = """use std::collections::HashMap;
pub const MAX: u32 = 3;
static mut COUNT: u32 = 0;
pub trait Named: Debug + Clone {
    fn name(&self) -> String;
}
pub struct Item {
    pub id: u64,
    count: u32,
}
impl Named for Item {
    fn name(&self) -> String {
        format!("{}", self.id);
        helper(self.id)
    }
}
mod inner {
    pub(crate) fn deep() { }
}
fn helper(n: u64) -> String {
    Item { id: n, count: 0 };
    n.to_string()
}
"""
TS = """import { a } from "./a";
export interface Named {
  name: string;
}
export class Shop extends Base implements Named {
  private items: string[] = [];
  static count: number = 0;
  async load(id: number): Promise<void> {
    await this.fetch(id);
    new Item(id);
  }
}
export function make(): Shop {
  return build();
}
const LIMIT = 3;
"""


def graph(spark):
    files = spark.createDataFrame([("Cart.java", JAVA), ("shop.py", PYTHON), ("shop.go", GO), ("item.rs", RUST), ("shop.ts", TS)], "path string, content string")
    return extract(walk(files))


def test_sources(spark):
    g = graph(spark)
    nodes = {(r["file"], r["qualified_name"]): r for r in g.nodes.collect()}
    kinds = {k: r["kind"] for k, r in nodes.items()}
    want = {
        "Cart.java": {"shop": "Package", "java.util.List": "Import", "java.lang.Math.*": "Import", "Cart": "Class", "Cart.MAX": "Constant", "Cart.count": "StaticField", "Cart.items": "Field", "Cart.Cart": "Method", "Cart.size": "Method", "Cart.size.s": "Variable", "Kind.A": "Constant", "Kind.B": "Constant", "Cart.empty": "Method", "Cart.Inner": "Class", "Cart.Inner.deep": "Method", "Cart.helper": "Method", "Sized": "Interface", "Sized.size": "Method", "Kind": "Enum"},
        "shop.py": {"os": "Import", "a.b.c": "Import", "LIMIT": "Constant", "name": "GlobalVariable", "Shop": "Class", "Shop.total": "Field", "Shop.__init__": "Method", "Shop.run": "Method", "_hidden": "Function"},
        "shop.go": {"shop": "Package", "fmt": "Import", "shop.Store": "Class", "shop.Store.name": "Field", "shop.Reader": "Interface", "shop.Reader.Read": "Method", "shop.NewStore": "Function", "shop.Store.Save": "Method"},
        "item.rs": {"std::collections::HashMap": "Import", "MAX": "Constant", "COUNT": "StaticField", "Named": "Interface", "Named::name": "Method", "Item": "Class", "Item::id": "Field", "Item::count": "Field", "Item::name": "Method", "inner": "Package", "inner::deep": "Function", "helper": "Function"},
        "shop.ts": {"./a.a": "Import", "Named": "Interface", "Named.name": "Field", "Shop": "Class", "Shop.items": "Field", "Shop.count": "StaticField", "Shop.load": "Method", "make": "Function", "LIMIT": "Constant"},
    }
    for file, names in want.items():
        found = {q: k for (f, q), k in kinds.items() if f == file and k not in ("File", "Parameter")}
        assert found == names, file
    visible = {k: r["visibility"] for k, r in nodes.items()}
    assert visible["Cart.java", "Cart.items"] == "Protected" and visible["shop.py", "_hidden"] == "Private" and visible["shop.py", "Shop.__init__"] == "Private"
    assert visible["shop.go", "shop.NewStore"] == "Public" and visible["shop.go", "shop.Store.name"] == "Internal"
    assert visible["item.rs", "inner::deep"] == "Internal" and visible["item.rs", "helper"] == "Private" and visible["shop.ts", "make"] == "Public"
    assert all((len(r["hash"]) == 64) == (r["kind"] == "File") if r["hash"] else r["kind"] != "File" for r in nodes.values())
    assert nodes["Cart.java", "Cart"]["is_abstract"] and nodes["shop.ts", "Shop.load"]["is_async"]

    name = {r["id"]: (r["file"], r["qualified_name"]) for r in nodes.values()}
    edges = {(*name[e["src"]], e["kind"], name[e["to_id"]][1] if e["to_id"] is not None else e["to_name"]) for e in g.edges.collect()}
    for e in [
        ("Cart.java", "Cart", "Extends", "Base"), ("Cart.java", "Cart", "Implements", "Sized"), ("Cart.java", "Cart", "Implements", "Closeable"), ("Cart.java", "Cart.size", "Throws", "IOException"),
        ("Cart.java", "Cart.size", "Calls", "Cart.helper"), ("Cart.java", "Cart.helper", "Instantiates", "Cart.Inner"), ("Cart.java", "Cart", "Contains", "Cart.Inner"), ("Cart.java", "Cart.Inner", "Contains", "Cart.Inner.deep"), ("Cart.java", "Cart.java", "Contains", "Cart"),
        ("shop.py", "Shop", "Extends", "Base"), ("shop.py", "Shop.run", "Awaits", "fetch"), ("shop.py", "Shop.run", "Calls", "os.path.join"), ("shop.py", "Shop.run", "Returns", "Result"), ("shop.py", "Shop.__init__", "Calls", "Shop.run"),
        ("shop.go", "shop.NewStore", "Instantiates", "shop.Store"), ("shop.go", "shop.Store.Save", "Calls", "fmt.Println"), ("shop.go", "shop.go", "Contains", "shop.Store.Save"),
        ("item.rs", "Named", "Extends", "Debug"), ("item.rs", "Item", "Implements", "Named"), ("item.rs", "Item::name", "Calls", "helper"), ("item.rs", "Item::name", "Calls", "format!"), ("item.rs", "helper", "Instantiates", "Item"), ("item.rs", "Item", "Contains", "Item::name"), ("item.rs", "inner", "Contains", "inner::deep"),
        ("shop.ts", "Shop", "Implements", "Named"), ("shop.ts", "Shop.load", "Awaits", "this.fetch"), ("shop.ts", "Shop.load", "Instantiates", "Item"), ("shop.ts", "make", "Calls", "build"), ("shop.ts", "make", "Returns", "Shop"),
    ]:
        assert e in edges, e
    assert not any("Nope" in str(e) or "Fake" in str(e) for e in edges)
    assert g.validate().count() == 0


def test_same_files_get_the_same_ids_and_resolve(spark):
    one, two = graph(spark), graph(spark)
    key = lambda g: sorted((r["id"], r["file"], r["qualified_name"]) for r in g.nodes.collect())
    assert key(one) == key(two)
    done = resolve(one).edges
    assert done.filter("to_state = 'Unresolved'").count() == 0
    assert done.filter("kind = 'Implements' and to_state = 'Resolved'").count() >= 2


STOCK = """package shop;
@Entity
@Table(name = "stock")
public class Stock<T extends Item, K> {
    private int count;
    private final Map<String, List<T>> shelves = new HashMap<>();
    public Stock(int count) {
        this.count = count;
    }
    @Override public void add(final T item, Map<String, List<K>> more,
            int... sizes) throws FullException {
        this.count += sizes.length;
        shelves.put(item.name(), one(1, 2));
        log();
    }
    int size() {
        return this.count;
    }
    enum Level {
        LOW(1), HIGH(2);
        int rank;
    }
}
"""
DEEP = "\n".join(f"{'  ' * i}class A{i} {{" for i in range(12)) + "\n" + "\n".join("  " * i + "}" for i in reversed(range(12)))
LIB = '''"""Text with ( an open
parenthesis and class Fake:
"""

@app.route("/x")
def view(a, b: int = 3,
         *rest, c: "str" = "(",
         **more) -> str:
    return a.b(c)


class Box(Base):
    @property
    def size(self):
        self.n += 1
        return self.n + self.limit
'''


def small(spark, **sources):
    files = spark.createDataFrame([(n.replace("_", "."), t) for n, t in sources.items()], "path string, content string")
    return files, extract(walk(files))


def test_members_parameters_and_spans(spark):
    files, g = small(spark, Stock_java=STOCK, Deep_java=DEEP, lib_py=LIB)
    rows = g.nodes.collect()
    node = {(r["file"], r["qualified_name"]): r for r in rows}
    lines = lambda f, q: (node[f, q]["span"]["start_line"], node[f, q]["span"]["end_line"])
    assert lines("Stock.java", "Stock") == (3, 22) and lines("Stock.java", "Stock.add") == (9, 14) and lines("Stock.java", "Stock.Level") == (18, 21) and lines("Stock.java", "Stock.count") == (4, 4)
    assert lines("Deep.java", "A0") == (0, 23) and lines("Deep.java", ".".join(f"A{i}" for i in range(12))) == (11, 12)
    assert lines("lib.py", "view") == (5, 8) and lines("lib.py", "Box") == (11, 15) and lines("lib.py", "Box.size") == (13, 15)
    assert not any("Fake" in q for _, q in node)
    one = node["Stock.java", "Stock"]
    assert one["attributes"] == ["@Entity", '@Table(name = "")'] and one["generic_params"] == ["T", "K"] and one["generic_bounds"] == ["T extends Item"]
    assert node["Stock.java", "Stock.Stock"]["is_constructor"] and not node["Stock.java", "Stock.add"]["is_constructor"] and node["Stock.java", "Stock.add"]["attributes"] == ["@Override"]
    types = {q: r["type_annotation"] for (f, q), r in node.items() if r["kind"] == "Parameter"}
    assert types == {"Stock.Stock.count": "int", "Stock.add.item": "T", "Stock.add.more": "Map<String, List<K>>", "Stock.add.sizes": "int...", "view.a": None, "view.b": "int", "view.c": '""'}
    assert node["Stock.java", "Stock.shelves"]["type_annotation"] == "Map<String, List<T>>"
    assert [r["name"] for r in sorted(rows, key=lambda r: r["id"]) if r["kind"] == "Constant"] == ["LOW", "HIGH"]

    done = resolve(g)
    name = {r["id"]: r["qualified_name"] for r in rows}
    edges = {(name[e["src"]], e["kind"], name.get(e["to_id"], e["to_name"]), e["call_arity"]) for e in done.edges.collect()}
    for e in [
        ("Stock.add", "Writes", "Stock.count", None), ("Stock.size", "Reads", "Stock.count", None), ("Stock.add", "Reads", "Stock.shelves", None), ("Stock.add", "Calls", "put", None), ("Stock.add", "Calls", "name", 0),
        ("Stock.add", "Calls", "log", 0), ("Stock.add", "Throws", "FullException", None), ("Stock.size", "Returns", "int", None), ("Stock.add", "HasParameter", "Stock.add.item", None), ("Stock.add.item", "HasType", "T", None),
        ("Stock.count", "HasType", "int", None), ("view", "Decorates", "app.route", None), ("Box.size", "Decorates", "property", None), ("Box.size", "Writes", "n", None), ("Box.size", "Reads", "limit", None), ("view", "Calls", "a.b", 1), ("view", "Returns", "str", None),
    ]:
        assert e in edges, e
    every = g.nodes.select("id")
    assert {(name[r["id"]], name[r["other"]]) for r in nb.readers_of(done, every).collect()} >= {("Stock.count", "Stock.size"), ("Stock.shelves", "Stock.add")}
    assert {name[r["other"]] for r in nb.parameters_of(done, every).collect()} == set(types)
    assert {name[r["id"]]: r["lcom"] for r in mt.lcom(done).collect()}["Stock"] == 0.0
    assert {name[r["other"]] for r in mt.unused_fields(done, every).collect()} == {"Stock.Level.LOW", "Stock.Level.HIGH", "Stock.Level.rank"}
    raw = {(e["kind"], e["to_name"]) for e in extract(walk(files), compat=True).edges.collect()}
    assert ("Reads", "shelves") in raw and ("Writes", "count") in raw

    snippets = {r["file"]: r["snippets"] for r in description_tasks(files, done.nodes).collect()}
    assert snippets["Stock.java"]["Stock.size"] == "    int size() {\n        return this.count;\n    }"
    assert snippets["lib.py"]["view"].endswith("return a.b(c)") and snippets["Stock.java"]["Stock"].count("\n") == 19


ODD_JAVA = """package p; import a.B; import static c.D.*;
@A(x = {1, 2}) public class K<T extends Q<R>, U> extends M<T, List<U>> implements I<T, U>, J { int x, y = f(1, 2); Map<String, List<T>> m = new HashMap<>(), n; K() { this.x = 1; } int f(Map<String, List<T>> a,
 int b) { for (int i = 0; i < b; i++) { g(this.x); } var s = h(y), t = 2; return s; } enum E { P, R(1) { void z() { } }; int q; } interface L { void w(); } } class Z { }
"""
ODD_PYTHON = """import os, sys as s, a.b
from .pkg import (x as y,
    z)
from q import *
class A(B[C, D], E): pass
class D:
  k: int = 1; j = 2
  def __init__(self, v): self.v = v; self.w, self.q = 1, self.v
  @staticmethod
  def st(first, second): return first
class F:
  k = 0
  def __init__(self):
    self.k = 1
    self.t: int = 2
    if k:
      self.deep = 3
    self.t = 4
def f(a, b=(1, 2)): return g(a, [1, 2])
"""
ODD_GO = """package p
import ("fmt"; f "x/fmt"; _ "z"
 . "dot")
const ( A = iota; B
 C, D = 1, 2 )
var x, y int
type ( T struct { B, C int `json:"b"`; *Base; m map[string][]int }
 R interface { io.Reader; Read(p []byte) (int, error); ~int | U } )
func (s *T) Do(a int, f func(int) error) (int, error) { return s.g(T{B: 1}) }
func F[K comparable, V any](m map[K]V) V { var z V; return z }
"""
ODD_RUST = """pub use std::{io::{self, Read as R}, fmt::*}; use a::b;
#[derive(Debug)] pub enum E<T: Into<Vec<u8>>> { A, B(T, u8), C { x: u8, y: u8 }, D = 4 }
pub struct S<'a, T> where T: Clone, T: Copy { pub x: HashMap<String, Vec<T>>, y: &'a str } struct U(u8, u8); struct V;
impl<T: Into<Vec<u8>>> Foo<T> for S<'_, T> { fn f(&self, a: Vec<(u8, u8)>, b: u8) -> Option<u8> { let mut k: u8 = self.x; g(k) } }
trait N: Debug + Fn(u8) -> u8 + 'static { fn z(&self); const W: u8; }
"""
ODD_TS = """import React, { useState as us, type X } from "react"; import * as ns from 'm'; import "./side";
export { a as b, c } from "./d"; export { q as w };
export class K<T extends Q, U = Map<string, number>> extends M<T> implements I<T, U>, J { private x: number = 0; y = 1; constructor(private z: string) { super(); } abstract go(a: Map<string, number>, b?: T): void; get v(): number { return this.x; } static s: string }
interface L { a: string; b(x: number): void
  c?: (q: number) => void }
enum E { A = 1, B }
export const f = 1,
  h = 2
export abstract class P
  extends O { run() { this.go(1); call(2); } }
"""


def test_layout_is_of_no_matter(spark):
    """Several declarations on a line, one over lines, blocks and lists of imports, and nested types."""
    _, g = small(spark, K_java=ODD_JAVA, a_py=ODD_PYTHON, t_go=ODD_GO, s_rs=ODD_RUST, k_ts=ODD_TS)
    rows = [r for r in g.nodes.collect() if r["kind"] != "File"]
    kinds = {}
    for r in rows:
        kinds.setdefault(r["file"], []).append((r["qualified_name"], r["kind"]))
    want = {
        "K.java": "p Package, a.B Import, c.D.* Import, K Class, K.x Field, K.y Field, K.m Field, K.n Field, K.K Method, K.f Method, K.f.a Parameter, K.f.b Parameter, K.f.s Variable, K.f.t Variable, K.E Enum, K.E.P Constant, K.E.R Constant, K.E.z Method, K.E.q Field, K.L Interface, K.L.w Method, Z Class",
        "a.py": "os Import, sys Import, a.b Import, .pkg.x Import, .pkg.z Import, q.* Import, A Class, D Class, D.k Field, D.j Field, D.__init__ Method, D.__init__.v Parameter, D.v Field, D.st Method, D.st.second Parameter, F Class, F.k Field, F.__init__ Method, F.t Field, f Function, f.a Parameter, f.b Parameter",
        "t.go": "p Package, fmt Import, x/fmt Import, dot Import, p.A Constant, p.B Constant, p.C Constant, p.D Constant, p.x GlobalVariable, p.y GlobalVariable, p.T Class, p.T.B Field, p.T.C Field, p.T.m Field, p.R Interface, p.R.Read Method, p.R.Read.p Parameter, p.T.Do Method, p.T.Do.a Parameter, p.T.Do.f Parameter, p.F Function, p.F.m Parameter",
        "s.rs": "std::io Import, std::io::Read Import, std::fmt::* Import, a::b Import, E Enum, E::A Constant, E::B Constant, E::C Constant, E::D Constant, S Class, S::x Field, S::y Field, U Class, V Class, S::f Method, S::f::a Parameter, S::f::b Parameter, S::f::k Variable, N Interface, N::z Method, N::W Constant",
        "k.ts": "react Import, react.useState Import, react.X Import, m Import, ./side Import, K Class, K.x Field, K.y Field, K.constructor Method, K.constructor.z Parameter, K.go Method, K.go.a Parameter, K.go.b Parameter, K.v Method, K.s StaticField, L Interface, L.a Field, L.b Method, L.b.x Parameter, L.c Field, E Enum, E.A Constant, E.B Constant, f Constant, h Constant, P Class, P.run Method",
    }
    for file, listed in want.items():
        assert sorted(kinds[file]) == sorted(tuple(x.rsplit(" ", 1)) for x in listed.split(", ")), file
    name = {r["id"]: (r["file"], r["qualified_name"]) for r in g.nodes.collect()}
    edges = {(*name[e["src"]], e["kind"], name[e["to_id"]][1] if e["to_id"] is not None else e["to_name"]) for e in g.edges.collect()}
    for e in [
        ("K.java", "K", "Extends", "M<T, List<U>>"), ("K.java", "K", "Implements", "I<T, U>"), ("K.java", "K", "Implements", "J"), ("K.java", "K.m", "HasType", "Map<String, List<T>>"), ("K.java", "K.f.a", "HasType", "Map<String, List<T>>"), ("K.java", "K.f", "Calls", "g"), ("K.java", "K.f", "Reads", "K.x"), ("K.java", "K.K", "Writes", "K.x"), ("K.java", "K.f", "Writes", "K.f.s"), ("K.java", "K.f", "Calls", "h"),
        ("a.py", "A", "Extends", "B[C, D]"), ("a.py", "A", "Extends", "E"), ("a.py", "D.__init__", "Writes", "D.v"), ("a.py", "D.__init__", "Writes", "w"), ("a.py", "D.__init__", "Writes", "q"), ("a.py", "D.__init__", "Reads", "D.v"), ("a.py", "F.__init__", "Writes", "F.k"), ("a.py", "F.__init__", "Writes", "deep"), ("a.py", "a.py", "Imports", "q"), ("a.py", "a.py", "Imports", ".pkg.x"), ("a.py", "f", "Calls", "g"),
        ("t.go", "p.T", "Extends", "Base"), ("t.go", "p.R", "Extends", "io.Reader"), ("t.go", "p.R", "Extends", "U"), ("t.go", "p.T.Do", "Instantiates", "p.T"), ("t.go", "p.T.Do", "Returns", "(int, error)"), ("t.go", "p.F", "Returns", "V"), ("t.go", "p.T.m", "HasType", "map[string][]int"), ("t.go", "p.T.C", "HasType", "int"), ("t.go", "t.go", "Imports", "x/fmt"),
        ("s.rs", "s.rs", "Reexports", "std::io::Read"), ("s.rs", "s.rs", "Imports", "a::b"), ("s.rs", "S", "Implements", "Foo"), ("s.rs", "S::f", "Returns", "Option<u8>"), ("s.rs", "S::f", "Calls", "g"), ("s.rs", "S::f", "Writes", "S::f::k"), ("s.rs", "S::x", "HasType", "HashMap<String, Vec<T>>"), ("s.rs", "N", "Extends", "Debug"), ("s.rs", "N", "Extends", "Fn(u8) -> u8"), ("s.rs", "S::f::a", "HasType", "Vec<(u8, u8)>"),
        ("k.ts", "k.ts", "Reexports", "./d.a"), ("k.ts", "k.ts", "Reexports", "./d.c"), ("k.ts", "k.ts", "Reexports", "w"), ("k.ts", "K", "Extends", "M<T>"), ("k.ts", "K", "Implements", "I<T, U>"), ("k.ts", "K", "Implements", "J"), ("k.ts", "K.v", "Reads", "K.x"), ("k.ts", "P", "Extends", "O"), ("k.ts", "P.run", "Calls", "call"), ("k.ts", "k.ts", "Imports", "react.useState"),
    ]:
        assert e in edges, e
    assert not any("Q" in str(e[3]) for e in edges if e[2] == "Extends")
    assert ("a.py", "D.__init__", "Reads", "w") not in edges and ("k.ts", "K", "Extends", "Q>") not in edges
    node = {(r["file"], r["qualified_name"]): r for r in rows}
    assert node["k.ts", "K"]["generic_params"] == ["T", "U"] and node["s.rs", "E"]["generic_bounds"] == ["T: Into<Vec<u8>>"] and node["t.go", "p.F"]["generic_params"] == ["K", "V"]
    assert node["s.rs", "E"]["attributes"] == ["#[derive(Debug)]"] and node["a.py", "sys"]["name"] == "s" and node["s.rs", "std::io::Read"]["metadata"]["alias"] == "R" and node["a.py", "q.*"]["metadata"] == {"wildcard": "true"}
    assert node["K.java", "K.f"]["span"]["start_line"] == 1 and node["K.java", "K.f"]["span"]["end_line"] == 2 and node["k.ts", "P"]["span"]["start_line"] == 8 and node["k.ts", "P"]["is_abstract"]


def test_hostile_sources_end_no_job(spark):
    """Unclosed brackets, strings and comments, very long lines and deep nesting give what they give."""
    odd = {"a.java": "class A { " * 200, "b.java": "}" * 500 + " class B { int x; }", "c.py": "x = (" + "(" * 2000, "d.py": '"""' + "a" * 100_000, "e.rs": "use a::{" * 300, "f.go": "import (\n" * 50, "g.ts": "`" + "${" * 1000, "h.java": "/*" + "*" * 100_000, "i.java": "class C { String s = \"" + "x" * 200_000 + "\"; int " + ", ".join(f"v{i}" for i in range(2000)) + "; }", "j.py": "", "k.rs": "\n\n", "l.ts": "f(" * 3000 + ")" * 3000}
    files = spark.createDataFrame(list(odd.items()), "path string, content string")
    g = extract(walk(files))
    found = {(r["file"], r["qualified_name"]) for r in g.nodes.collect()}
    assert ("b.java", "B.x") in found and ("i.java", "C.v1999") in found and g.edges.count() > 0 and g.validate().count() == 0


def test_files_are_cut_in_one_pass(spark):
    """Tokens stay one row a file, and a file that goes over batches has the scopes of one that doesn't."""
    import pyarrow as pa

    from codeloom.jobs.extract import KEPT, enclosed_by_file
    from codeloom.jobs.statements import tokens

    files = spark.createDataFrame([("A.java", "class A { int f() { return 1; } }\n" * 3, "java")], "path string, content string, ext string")
    assert tokens(files).count() == 1
    row = {"language": "Java", "raw": "", "code": "", "marks": [], "d": None, "name": "x", "modifiers": ""}
    rows = [row | {"path": p, "at": a, "line": a, "last": a, "depth": d, "closing": False, "holder": h} for p in "ab" for a, (d, h) in enumerate([(0, "Class"), (4, "Method"), (8, None), (4, None), (0, "Class")])]
    whole = pa.RecordBatch.from_pylist(rows)
    one = pa.Table.from_batches(enclosed_by_file([whole])).to_pylist()
    many = pa.Table.from_batches(enclosed_by_file([whole.slice(i, 1) for i in range(len(rows))])).to_pylist()
    assert one == many and len(one) == 10 and set(KEPT) <= set(one[0])
    assert [r["end"] for r in one[:5]] == [3, 2, 2, 3, 4] and [len(r["scope"]) for r in one[:5]] == [0, 1, 2, 1, 0]


def test_files_are_dealt_once_and_edges_found_once(spark):
    """Statements get their scopes without a second shuffle or a sort, and numbering edges doesn't find them again."""
    from codeloom.jobs.extract import scoped_statements

    files = spark.createDataFrame([("a.go", GO, "go", "h")], "path string, content string, ext string, hash string")
    plan = scoped_statements(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Sort" not in plan
    plan = extract(files).edges._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" not in plan


def test_simple_brackets_are_one_token(spark):
    """Round brackets that hold no others come as one token, but for Go's groups, and statements are those of single tokens."""
    from codeloom.jobs.statements import cut, tokens

    text = "import (a)\nfunc (s T) F(a int) { g(h(1), 2); const (b) }\n"
    for language, ext in (("Go", "go"), ("Rust", "rs"), ("TypeScript", "ts")):
        files = spark.createDataFrame([("a", text, ext)], "path string, content string, ext string")
        toks = tokens(files).first()["toks"]
        single = [x for t in toks for x in (("(", t[1:-1], ")") if len(t) > 1 and t[0] == "(" else (t,)) if x]
        assert "".join(toks) == text and "(s T)" in toks and ("(a)" in toks) == (ext != "go")
        assert list(cut(language, toks)) == list(cut(language, single))


def test_idle_statements_are_left_behind(spark):
    """Statements of brackets alone count for scopes and ends and aren't stored; names are looked up without a sort."""
    from codeloom.jobs.extract import scoped_statements, within_file

    files = spark.createDataFrame([("A.java", "class A { int f() { { g(); } ; } int h() { } }\n", "java")], "path string, content string, ext string")
    rows = scoped_statements(files).orderBy("at").collect()
    assert [r["code"].strip() for r in rows] == ["class A {", "int f() {", "g();", "int h() {"]
    assert [len(r["scope"]) for r in rows] == [0, 1, 2, 1]
    refs = spark.createDataFrame([("a", "f", ["p"], ["A", "m"], ".", "this.f"), ("a", "g", ["p"], ["A", "m"], ".", "g"), ("a", "h", [], [], ".", "h")], "path string, owner string, head array<string>, names array<string>, separator string, target string")
    named = spark.createDataFrame([("a", "p.f"), ("a", "p.A.f"), ("a", "p.A.m.g"), ("b", "h")], "path string, qualified_name string")
    found = within_file(refs, named)
    assert {(r["owner"], r["target"]) for r in found.collect()} == {("f", "p.A.f"), ("g", "p.A.m.g"), ("h", "h")}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
