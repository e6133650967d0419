"""Framework relations of PHP sources."""

from graphloom.operators import related
from graphloom.sources import framework, lexical, python_code

PHP = """<?php
namespace App;
use Lib\\Mail as Post;
use Illuminate\\Support\\Facades\\Route;
class P {
  public function __construct(private ?Post $m, int $n, \\Top\\Log $l, Near|Far $x) {}
  public function register() {
    $this->app->singleton(Face::class, Body::class);
    App::bind(Face::class, new Body(1));
    $x = app(Face::class); /* resolve(No::class) */
    dispatch(new Job($x, [1, 2]));
    Job::dispatchSync(3);
    $schedule->job(new Job);
    $this->commands([One::class, Two::class]);
    Gate::policy(Model::class, Rule::class);
    $other->bind(Face::class, Body::class);
  }
}
Route::get('/a', [Page::class, 'show']);
Route::post("/b", Page::class);
Event::listen(Happened::class, Hears::class);
"""


def test_statements():
    rows, omitted = framework.statements("r/p.php", PHP)
    got = [(x["kind"], "|".join(x["from_names"]) or x["synthetic"], "|".join(x["to_names"]), x["line"]) for x in rows]
    here = "App::P::register"
    assert omitted == 0 and got == [
        ("DEPENDS_ON", "App::P", "Lib::Mail", 6), ("DEPENDS_ON", "App::P", "Top::Log", 6), ("BINDS", "App::Face", "App::Body", 8), ("BINDS", "App::Face", "App::Body", 9),
        ("RESOLVES", here, "App::Face", 10), ("DISPATCHES", here, "App::Job::handle", 11), ("DISPATCHES", here, "App::Job::handle", 12), ("SCHEDULES", here, "App::Job::handle", 13),
        ("REGISTERS", here, "App::One::handle", 14), ("REGISTERS", here, "App::Two::handle", 14), ("AUTHORIZES_WITH", "App::Model", "App::Rule", 15),
        ("ROUTES_TO", "Laravel::route::r/p.php:19:1", "App::Page::show", 19), ("ROUTES_TO", "Laravel::route::r/p.php:20:1", "App::Page::__invoke", 20), ("LISTENS_TO", "App::Hears::handle|App::Hears::__invoke", "App::Happened", 21),
    ]


def test_limits_and_odd_files():
    assert framework.statements("a.py", PHP) == ([], 0) == framework.statements("a.php", None)
    rows, omitted = framework.statements("a.php", "<?php " + "app(A::class);" * 2050)
    assert len(rows) == 2048 and omitted == 2
    for junk in ("<?php Route::get(", "app(" * 500, "Event::listen(,)", "Route::get([[[", "bind("):
        framework.statements("a.php", junk)


def test_endpoints(spark):
    more = "<?php\nnamespace App;\nclass Job { function handle() {} }\nclass Page { function show() {} }\nclass Face {}\n"
    d = spark.createDataFrame([("p.php", PHP), ("q.php", more), ("n.php", None)], "path string, text string")
    r = framework.relations(framework.parse(d))
    s = python_code.symbols(lexical.parse(d))
    got = related.endpoint(r.selectExpr("request", "to_names AS names"), s).join(s.selectExpr("id AS target", "qualified_name"), "target").join(r, "request")
    assert sorted((x.kind, x.qualified_name) for x in got.collect()) == [("DISPATCHES", "App::Job::handle")] * 2 + [("RESOLVES", "App::Face"), ("ROUTES_TO", "App::Page::show"), ("SCHEDULES", "App::Job::handle")]
    c = spark.createDataFrame([('{"require": {"laravel/framework": "1"}}',), ('{"require": {}}',), ("no",), (None,)], "t string")
    assert [x[0] for x in c.select(framework.uses_framework(c.t)).collect()] == [True, False, False, False]
