"""A small file of each language, and the declarations, calls and type relations that are read from it.

{K} in a path, and in the names that follow from it, stands for a number that keeps files apart.
"""

SAMPLES = {
    'src/a{K}/lib.rs': (
        "use std::io;\nconst N: u32 = 1;\npub struct P { pub x: i32, y: Vec<u8> }\ntrait T { fn go(&self); }\nimpl T for P {\n    fn go(&self) { self.low(1); Q::make(); helper(2); /* no() */ }\n}\nfn helper(a: i32) -> char { '{' }\n#[test]\nfn works() { helper(1); p.go(); util::run() }\n",
        'constant a{K}::N, struct a{K}::P, field a{K}::P::x, field a{K}::P::y, trait a{K}::T, method a{K}::T::go, impl_block a{K}::P, method a{K}::P::go, function a{K}::helper, test a{K}::works',
        'go member method low P, go scoped method make Q, go function function helper None, works function function helper None, works member method go None, works scoped function run util',
        'implements a{K}::T',
    ),
    'm/x{K}.go': (
        'package m\n\nimport "fmt"\n\ntype S struct {\n\tName string\n}\n\ntype I interface {\n\tDo(x int) error\n}\n\nconst K = 1\n\nfunc (s *S) Do(x int) error {\n\tfmt.Println("a(b)")\n\treturn helper(x)\n}\n\nfunc helper(x int) error { return nil }\n',
        'struct m::x{K}::S, field m::x{K}::S::Name, interface m::x{K}::I, method m::x{K}::I::Do, constant m::x{K}::K, method m::x{K}::S::Do, function m::x{K}::helper',
        'Do member method Println None, Do function function helper None',
        '',
    ),
    'src/main/java/a/B{K}.java': (
        'package a.b;\nimport java.util.List;\npublic class B extends Base implements I, J<String> {\n  private int n = make(3);\n  B(int n) { this.n = n; run(); }\n  @Test(timeout = 3)\n  void t() { this.go(); Util.f(); new B(1); x.y(); }\n  enum E { A, C }\n}\ninterface K { int f(String s); }\n',
        'class a::b::B, field a::b::B::n, method a::b::B::constructor, test a::b::B::t, enum a::b::B::E, constant a::b::B::E::A, constant a::b::B::E::C, interface a::b::K, method a::b::K::f',
        'constructor function method run None, t member method go B, t scoped method f Util, t scoped method constructor B, t member method y None',
        'extends a::b::Base, implements a::b::I, implements a::b::J',
    ),
    'src/w/a{K}.ts': (
        'import {a as b} from "./m";\nexport interface Q { n: number; f(x: string): void }\nexport class W extends V implements Q {\n  n: number = 1;\n  constructor(x) { super(x); this.f("}"); }\n  f(x: string): void { b(x); new V(); W.g(); }\n}\nexport const g = (x: number) => { return h(x); };\nfunction h(x) { return x; }\ntype T = string;\nit("does it", () => { h(1); });\n',
        'interface w::a{K}::Q, property w::a{K}::Q::n, method w::a{K}::Q::f, class w::a{K}::W, property w::a{K}::W::n, method w::a{K}::W::constructor, method w::a{K}::W::f, function w::a{K}::g, function w::a{K}::h, type_alias w::a{K}::T, test w::a{K}::does it',
        'constructor member method f W, f scoped function a w::m, f scoped method constructor V, f scoped method g W, g function function h None, does it function function h None',
        'extends w::a{K}::V, implements w::a{K}::Q',
    ),
    'a{K}.js': (
        'const m = require("./m");\nclass A { f() { return m.x(1); } }\nexports.z = function (q) { return q(); };\n',
        'constant a{K}::m, class a{K}::A, method a{K}::A::f, function a{K}::z',
        'f scoped function x m, z function function q None',
        '',
    ),
    'a{K}.php': (
        '<?php\nnamespace App\\Http;\nuse App\\M;\nclass C extends B implements I {\n  const X = 1;\n  private ?int $p = 2;\n  public function go($a) { $this->run(); M::make(); self::q(); helper(); $a?->x(); new M(); }\n  public function testIt() {}\n}\nfunction helper() {}\n',
        'module App::Http, class App::Http::C, constant App::Http::C::X, property App::Http::C::p, method App::Http::C::go, test App::Http::C::testIt, function App::Http::helper',
        'go member method run C, go scoped method make App::M, go scoped method q C, go function function helper None, go nullsafe_member method x None, go scoped method __construct App::M',
        'extends App::Http::B, implements App::Http::I',
    ),
    'a{K}.cs': (
        'using System;\nnamespace N.M {\n public class C : B, IQ {\n  int f = 1;\n  public int P { get { return Calc(); } }\n  public C(int a) { this.Go(a); }\n  [Fact]\n  public void T() { Util.Run(); new C(2); }\n }\n}\n',
        'class N::M::C, field N::M::C::f, property N::M::C::P, method N::M::C::constructor, test N::M::C::T',
        'constructor member method Go C, T scoped method Run Util, T scoped method constructor C',
        'extends N::M::B, implements N::M::IQ',
    ),
    'a/x{K}.cpp': (
        '#include <x>\nnamespace n {\nclass A : public B { int f; void g(); };\nvoid A::g() { h(1); x->y(); B::z(); }\nint h(int a) { return a; }\n}\n',
        'module a::x{K}::n, class a::x{K}::n::A, field a::x{K}::n::A::f, method a::x{K}::n::A::g, method a::x{K}::n::A::g, function a::x{K}::n::h',
        'g function method h None, g member method y None, g function method z B',
        'extends a::x{K}::n::B',
    ),
    's/a{K}.sh': (
        '#!/bin/bash\nsource ./lib.sh\ngreet() {\n  hello "x" | other\n  if check; then bye; fi\n}\nfunction two {\n  greet\n}\n',
        'module s::a{K}, function s::a{K}::greet, function s::a{K}::two',
        'greet function function hello None, greet function function other None, greet function function check None, greet function function bye None, two function function greet None',
        '',
    ),
    't/main{K}.tf': (
        'resource "aws_x" "y" {\n  name = var.n\n  ids  = [data.aws_z.q.id]\n  k = lower(local.z)\n}\nvariable "n" {\n  default = 1\n}\nmodule "m" {\n  source = "./m"\n}\n',
        'module t::main{K}, configuration t::main{K}::resource::aws_x::y, property t::main{K}::resource::aws_x::y::name, property t::main{K}::resource::aws_x::y::ids, property t::main{K}::resource::aws_x::y::k, property t::main{K}::variable::n, property t::main{K}::variable::n::default, module t::main{K}::module::m, property t::main{K}::module::m::source',
        'y scoped configuration n variable, y scoped configuration q data::aws_z, y function function lower None, y scoped configuration z locals',
        '',
    ),
    "q/p{K}.py": (
        "import os\nfrom .near import low\n\nclass A(Base):\n    n = 1\n\n    def go(self):\n        self.own()\n        low(2)\n        return os.path(3)\n\n\ndef test_it():\n    A().go()\n",
        "class q::p{K}::A, property q::p{K}::A::n, method q::p{K}::A::go, test q::p{K}::test_it",
        "go member method own A, go scoped function low q::near, go scoped function path os, test_it member method go None, test_it scoped method __init__ A",
        "extends q::p{K}::Base",
    ),
}
