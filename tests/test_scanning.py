"""Hand-worked sources: what is declared, where, by whom."""

import pytest

from tessera.operators import lexing, scanning


def found(language, source):
    return [(k, n, p, e, a + 1, b + 1) for k, n, p, e, _, a, b in scanning.symbols(language, source)]


SCRIPTS = {
    "arrow with parameters over several lines": ("export const g = async (\n  a: string,\n  { b, c }: { b: () => void; c?: number } = {},\n): Promise<Map<string, { d: 1 }>> => {\n  return a;\n};\n", [("function", "g", None, True, 1, 6)]),
    "arrow without brackets or braces": ("const f = x => x * 2, h = async y => ({ y });\nlet z = a ? b : c;", [("function", "f", None, False, 1, 1), ("function", "h", None, False, 1, 1)]),
    "arrow over lines without braces": ("const f = (a) =>\n  a\n    .map(b => b)\n    .filter(Boolean)\nconst g = 1", [("function", "f", None, False, 1, 4)]),
    "arrow of a typed variable": ("const f: (a: string) => void = (a) => { };\nconst n: Map<string, () => void> = new Map();", [("function", "f", None, False, 1, 1)]),
    "generic arrow": ("export const id = <T,>(x: T): T => x;\nconst two = <A extends { a: 1 }, B>(a: A, b: B) => [a, b];", [("function", "id", None, True, 1, 1), ("function", "two", None, False, 2, 2)]),
    "function expressions": ("const f = function () { }, g = async function* named() { };\nrun(function () { }); new Foo(function cb() { });", [("function", "f", None, False, 1, 1), ("function", "g", None, False, 1, 1)]),
    "in the middle of a line": ("let a = 1; function f() { } class C { m() { } } export async function* g() { }", [("function", "f", None, False, 1, 1), ("class", "C", None, False, 1, 1), ("method", "m", "C", False, 1, 1), ("function", "g", None, True, 1, 1)]),
    "overloads": ("function f(a: string): { a: 1 };\nfunction f(a: any): any { }\ndeclare function g(): void;", [("function", "f", None, False, 2, 2)]),
    "nameless defaults": ("export default function () {\n}\n", [("function", "anonymous", None, True, 1, 2)]),
    "nameless class": ("export default class extends B {\n  m() { }\n}", [("class", "anonymous", None, True, 1, 3), ("method", "m", None, True, 2, 2)]),
    "strings, templates and comments": ("const a = `}${`{${b}`}` + '}' + \"{\"; // {\n/* function no() { */\nfunction f() { return `function no() {}`; }", [("function", "f", None, False, 2, 3)]),
    "regular expressions": ("const r = /[/}{]\\/{/g, d = a / b / c;\nfunction f(x) { return /}/.test(x) ? x / 2 : /\\)/; }", [("function", "f", None, False, 2, 2)]),
    "members": (
        "class C<T extends { a: 1 }> extends B<T> implements I {\n  static #p = 1;\n  #q = async (a) => { };\n  constructor(private a: string) { super(); }\n  get v(): number { return 1; }\n  set v(x) { }\n  static async *gen<A>(a: A): AsyncGenerator<A> { }\n  abstract sig(): void;\n"
        "  'quoted'() { }\n  [Symbol.iterator]() { }\n  static { init(); }\n  get() { }\n  f = function () { };\n  h = (x: { a: 1 }): void => x\n  async\n  m?(): void { }\n  i: Map<string, () => { }> = new Map();\n}",
        [("class", "C", None, False, 1, 18), ("method", "#q", "C", False, 3, 3), ("method", "constructor", "C", False, 4, 4), ("method", "v", "C", False, 5, 5), ("method", "v", "C", False, 6, 6), ("method", "gen", "C", False, 7, 7),
         ("method", "quoted", "C", False, 9, 9), ("method", "[Symbol.iterator]", "C", False, 10, 10), ("method", "get", "C", False, 12, 12), ("method", "h", "C", False, 14, 14), ("method", "m", "C", False, 15, 16)],
    ),
    "decorators": ("/** doc */\n@A({ b: ')' })\n@B.c\nexport class C {\n  @D() @E m() { }\n  // said\n  @F('{')\n  n() { }\n}", [("class", "C", None, True, 1, 9), ("method", "m", "C", True, 5, 5), ("method", "n", "C", True, 6, 8)]),
    "interfaces, enums, types": (
        "export interface I<T> extends J<{ a: 1 }> { m(): void; f: () => { } }\nconst enum E { A = '}' }\nexport type T =\n  | { a: () => void }\n  | 'b'\n  | (T extends infer U ? U : never)[];\ntype F = (a: string) => { b: 1 }\nlet type = 1; type = 2;\ninterface = 3;",
        [("interface", "I", None, True, 1, 1), ("enum", "E", None, False, 2, 2), ("type", "T", None, True, 3, 6), ("type", "F", None, False, 7, 7)],
    ),
    "methods of objects": ("const o = { m(a) { }, async n() { }, get p() { return 1 }, q: 1, ['x'](){ }, r: () => 1, s() { } };\nif (a) { call(b) }\n{ block(c) }", [("method", "m", None, False, 1, 1), ("method", "n", None, False, 1, 1), ("method", "p", None, False, 1, 1), ("method", "s", None, False, 1, 1)]),
    "levels": (
        "export class C {\n  m() {\n    function near() { }\n    const arrow = () => { };\n    if (a) { function far() { } if (b) { function deep() { } } }\n  }\n}\nexport function f() { function inner() { } const k = () => 1; }",
        [("class", "C", None, True, 1, 7), ("method", "m", "C", True, 2, 6), ("function", "near", "C", False, 3, 3), ("function", "arrow", "C", False, 4, 4), ("function", "far", "C", False, 5, 5), ("function", "deep", None, False, 5, 5), ("function", "f", None, True, 8, 8), ("function", "inner", None, True, 8, 8), ("function", "k", None, False, 8, 8)],
    ),
    "class expressions": ("const A = class { m() { } };\nconst B = class Named extends A { n() { } };", [("method", "m", None, False, 1, 1), ("method", "n", None, False, 2, 2)]),
    "keys that look like keywords": ("const o = { class: 1, function: 2, type: 3 }; o.class; o?.function; a.type = 4;\nfunction f() { }", [("function", "f", None, False, 2, 2)]),
    "comparisons are no types": ("if (a < b && c > d) { }\nfor (let i = 0; i < n; i++) { }\nfunction f() { return a < b; }", [("function", "f", None, False, 3, 3)]),
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_typescript(name):
    source, want = SCRIPTS[name]
    assert found("TypeScript", source) == want


def test_elements():
    source = "export const App = ({ a }: P) => (\n  <div title='it\\'s' on={() => { go('}') }}>\n    Don't {a ? <b>{`}`}</b> : <></>} count &lt; {a.map(x => <Li key={x} />)}\n  </div>\n);\nfunction Other() { return a < b ? <A.B c=\"{\" /> : null; }\n"
    source = source.replace("it\\'s", "it")
    assert found("TypeScript (React)", source) == [("function", "App", None, True, 1, 5), ("function", "Other", None, False, 6, 6)]
    assert found("JavaScript", source.replace(": P", "")) == [("function", "App", None, True, 1, 5), ("function", "Other", None, False, 6, 6)]
    assert found("TypeScript (React)", "const id = <T,>(x: T) => x;\nconst e = <T extends A>(x: T) => x;") == [("function", "id", None, False, 1, 1), ("function", "e", None, False, 2, 2)]


def test_go():
    source = (
        "package a\n\nimport \"fmt\"\n\n// R is\ntype R[T any] struct {\n\tx map[string]interface{}\n}\n\ntype (\n\tA int\n\tB struct{ c int }\n)\n\ntype F func(a int) error\n\n// New makes\nfunc New[T any](a, b int) (*R[T], error) {\n\ts := `}{`\n\tr := '}'\n"
        "\tf := func() { type L int }\n\treturn nil, nil\n}\n\nfunc (r *R[T]) Go(x interface{}) struct{ y int } {\n}\n\nfunc asm(a int) int\n"
    )
    assert found("Go", source) == [("class", "R", None, False, 5, 8), ("class", "A", None, False, 10, 13), ("class", "F", None, False, 15, 15), ("function", "New", None, False, 17, 23), ("class", "L", None, False, 21, 21), ("method", "Go", None, False, 25, 26), ("function", "asm", None, False, 28, 28)]


def test_cpp():
    source = (
        '#define X {\n#include <a>\nnamespace n { namespace {\ntemplate <typename T, int N = 3>\nclass C final : public B<T> {\n public:\n  C() : a_(1), b_{2}, c_{3} { }\n  ~C() override = default;\n  int get() const noexcept { return x[0]; }\n  bool operator==(const C& o) const { return true; }\n  void sig(int);\n'
        '  enum class E { A };\n  struct In { int z; };\n  int n_ = 1\'000;\n  std::vector<int> v{1, 2};\n};\n} }\nstruct { int a; } nameless;\nstatic const char* raw = R"x(}{)x";\nstd::map<int, std::string> n::C::make(std::function<int(int)> f) { auto l = [](int) { return 1; }; return {}; }\nextern "C" { int main(int argc, char** argv) try { } catch (...) { } }\nint later(int);\nusing K = int;\n'
    )
    got = found("C++", source)
    assert got == [
        ("class", "C", None, False, 4, 16), ("function", "C", "C", False, 7, 7), ("function", "~C", "C", False, 8, 8), ("function", "get", "C", False, 9, 9), ("function", "operator==", "C", False, 10, 10), ("class", "In", "C", False, 13, 13),
        ("class", "anonymous", None, False, 18, 18), ("function", "make", None, False, 20, 20), ("function", "main", None, False, 21, 21),
    ]


@pytest.mark.parametrize(("language", "source"), [("TypeScript", "const a = `x${"), ("TypeScript", "const a = 'x\n'"), ("JavaScript", "f(("), ("TypeScript", "}"), ("Go", "s := `x"), ("C++", "/* x"), ("TypeScript (React)", "const a = <div>"), ("TypeScript", "(]")])
def test_sources_that_do_not_end(language, source):
    with pytest.raises(lexing.LexingError):
        scanning.symbols(language, source)


def test_tokens_are_the_source():
    for source, _ in SCRIPTS.values():
        found_tokens = lexing.tokens(source, "TypeScript")
        assert all(t.text == source[t.start : t.end] for t in found_tokens) and "".join(t.text for t in found_tokens).replace(" ", "").replace("\n", "") == source.replace(" ", "").replace("\n", "")


def test_facts_of_scripts():
    source = (
        "import A, {\n  b,\n  type C,\n} from './a';\nimport 'side';\nimport type { D } from \"d\";\nimport * as e from '../e'\nconst lazy = import('./no'); import.meta.url;\nexport { f } from './f';\nexport * from './g';\nexport default class H<T> extends I.J<T> { @K({ l: `)` }) m() { } }\n@N class O extends P { }\n// import q from 'q'\nconst s = \"import r from 'r'\";\n"
    )
    assert scanning.facts("TypeScript", source) == [
        ("import", "./a", None), ("import", "side", None), ("import", "d", None), ("import", "../e", None), ("export", "export { f } from './f';", None), ("export", "export * from './g';", None),
        ("export", "export default class H<T> extends I.J<T> { @K({ l: `)` }) m() { } }", None), ("inheritance", "H", "I.J"), ("decorator", "@K({ l: `)` })", None), ("decorator", "@N", None), ("inheritance", "O", "P"),
    ]
    assert scanning.facts("Go", "package x") == []


def test_plain_code_takes_one_match_a_token(monkeypatch):
    """Before, every token was tried against the blank's, then the name's pattern."""

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.n = pattern, 0

        def match(self, *args):
            self.n += 1
            return self.pattern.match(*args)

    source = "export function big() {\n" + "  step();\n" * 500 + "}"
    want = lexing.tokens(source, "JavaScript")
    for name in ("_SPACE", "_NAME", "_PLAIN"):
        monkeypatch.setattr(lexing, name, Counted(getattr(lexing, name)))
    assert lexing.tokens(source, "JavaScript") == want and len(want) == 2007
    assert lexing._SPACE.n + lexing._NAME.n < 20 and lexing._PLAIN.n < 2020


def test_plain_names_are_not_cut_out_of_others():
    kinds = lambda source, language: [(t.kind, t.text) for t in lexing.tokens(source, language)]
    assert kinds('a R"(b;)" u8R"x(;)x" L"c"', "C++") == [("name", "a"), ("string", 'R"(b;)"'), ("string", 'u8R"x(;)x"'), ("name", "L"), ("string", '"c"')]
    assert kinds("return /a;b/g; x /2/ y", "JavaScript") == [("name", "return"), ("regex", "/a;b/g"), ("mark", ";"), ("name", "x"), ("mark", "/"), ("number", "2"), ("mark", "/"), ("name", "y")]
