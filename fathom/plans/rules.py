"""Rules over declarations, all evaluated in one pass over one row a declaration.

A rule is a condition on the facts of a declaration: its own columns, those of
its parent, counts of its children and of the references to and from it, and
whether the live set has it.  Facts are grouped counts and joins on ids,
whatever the number of rules; only what the chosen rules ask is computed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.scratch import stash
from fathom.operators import graph as G
from fathom.plans.roots import contains_any, is_convention, is_word

c = F.col
SCOPE = ["let", "apply", "also", "run", "with", "takeif", "takeunless"]
LEAKS = "activity bitmap context dialog drawable fragment handler toast view windowmanager".split()
MUTABLE = "behaviorsubject mutablelivedata mutablesharedflow mutablestate mutablestateflow publishsubject replaysubject".split()
HOT = "computeScroll dispatchDraw draw onAnimationUpdate onBindViewHolder onDraw onInterceptTouchEvent onLayout onMeasure onScrollChanged onScrolled onTouchEvent".split()
DATA = "ApiService Dao DataStore Database HttpClient Retrofit SharedPreferences".split()
LIFECYCLE = (
    "onActivityCreated onActivityResult onAttach onBind onConfigurationChanged onCreate onCreateView onDestroy onDestroyView onDetach onLowMemory onNewIntent onPause "
    "onReceive onRequestPermissionsResult onRestart onRestoreInstanceState onResume onSaveInstanceState onStart onStartCommand onStop onTrimMemory onUnbind onViewCreated"
).split()
WIRED = (
    "AssistedFactory AssistedInject BindingAdapter BindingConversion BindingMethod BindingMethods Binds BindsInstance BindsOptionalOf DELETE Delete ElementsIntoSet Factory GET HEAD HTTP "
    "Inject Insert IntoMap IntoSet InverseBindingAdapter KoinViewModel Multibinds OPTIONS OnClick OnLifecycleEvent PATCH POST PUT Preview Provides Query RawQuery Single Subscribe Transaction Update"
).split()
#: Types that a view model must not hold, and wrappers that make them harmless.
VIEWS = (
    "Activity AlertDialog AppBarLayout AppCompatActivity Bitmap BottomSheetDialog BottomSheetDialogFragment Button CardView CheckBox ComponentActivity ConstraintLayout Context CoordinatorLayout Dialog "
    "DialogFragment Drawable EditText Fragment FragmentActivity FrameLayout ImageButton ImageView LayoutInflater LinearLayout NestedScrollView PopupMenu PopupWindow ProgressBar RadioButton RecyclerView "
    "RelativeLayout ScrollView SeekBar Snackbar Switch TabLayout TextView Toast Toolbar View ViewGroup ViewPager ViewPager2 WebView Window"
).split()
NOT_MODELS = "activity adapter appcompatactivity bottomsheetdialogfragment broadcastreceiver componentactivity contentprovider dialogfragment fragment fragmentactivity recyclerview service view viewgroup".split()
WORKERS = "CoroutineWorker JobIntentService JobService ListenableWorker RxWorker Worker".split()
TESTS = ["Test", "Before", "After", "Rule"]
TYPES = ["Class", "Interface", "Object", "Enum", "TypeAlias", "Annotation"]


def low(*words: str) -> Column:
    """The lower-case name has one of the words."""
    return c("lname").rlike("|".join(words))


def fun() -> Column:
    return c("kind").isin("Method", "Function")


def prop() -> Column:
    return c("kind").isin("Property", "Field")


def held(*words: str) -> Column:
    return contains_any("anns", list(words))


def ends(col: str, *words: str) -> Column:
    return c(col).rlike("(" + "|".join(words) + ")$")


def every(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)


def suppressed(anns: str, *codes: str) -> Column:
    """A suppression in the annotations names one of the codes as a whole word, in any case."""
    return c(anns).rlike(r"(?i)Suppress\w*\([^)]*(?<![A-Za-z0-9_])(?:" + "|".join(codes) + r")(?![A-Za-z0-9_])")


UNUSED = ["unused", "UnusedPrivateMember", "UnusedPrivateClass", "UnusedPrivateProperty"]


@dataclass(frozen=True)
class Rule:
    """A code, its condition, and the confidence of a finding, both over facts."""

    code: str
    when: Column
    confidence: Column


@dataclass(frozen=True)
class Limits:
    """Configurable thresholds."""

    method_lines: int = 50
    class_methods: int = 30
    class_props: int = 20
    params: int = 6
    lateinit: int = 5
    repositories: int = 2
    model_methods: int = 15
    model_params: int = 6
    depth: int = 3


def spared() -> Column:
    """What both dead-code analyses pass over: called by others than the code, or no code."""
    generated = (c("kind").isin("Method", "Function") & (c("pkind") == "Class") & (c("language") == "Kotlin") & c("pmods").rlike(r"(^| )data( |$)")) & (
        c("name").isin("copy", "equals", "hashCode", "toString") | c("name").rlike("^component[0-9]+$")
    )
    return reduce(lambda a, b: a | b, [
        is_convention(),
        (c("kind") == "Property") & (c("language") == "Kotlin") & is_word("mods", "const"),
        G.serialized(),
        generated,
        is_word("mods", "override") | F.contains("anns", F.lit("Override")),
        (c("kind") == "Method") & c("name").isin(LIFECYCLE) & (c("psupers") != ""),
        suppressed("anns", *UNUSED),
        F.contains("anns", F.lit("VisibleForTesting")),
        held(*TESTS),
    ])


def rules(x: Limits = Limits()) -> list[Rule]:
    """Every rule."""
    high, medium, low_ = F.lit("High"), F.lit("Medium"), F.lit("Low")
    under_dead_type = c("parent_id").isNotNull() & ~c("p_live") & (c("pkind").isin(TYPES) | (c("kind") == "Constructor"))
    bare_constructor = (c("kind") == "Constructor") & (c("visibility") == "Private") & (c("c_params") == 0)
    dead = ~c("is_live") & ~c("kind").isin("File", "Package", "Parameter", "Import") & ~spared() & ~under_dead_type & ~bare_constructor
    member = every(
        c("is_live"), ~c("is_root"), c("parent_id").isNotNull(), c("p_live"), ~c("kind").isin("Class", "Interface", "Object", "File", "Package", "Constructor", "Import"),
        ~spared(), ~held(*WIRED), (c("visibility") != "Public") | (c("n_in") == 0),
    )
    path = lambda *names: c("file").rlike("/(" + "|".join(names) + ")/")
    debug = F.contains("name", F.lit("Debug")) | path("debug", "staging")
    helper = ~path("test", "androidTest") & c("name").rlike("Mock|Fake|Stub|TestHelper|TestUtil|TestData|ForTest|InTest")
    deprecated = held("Deprecated") & (c("n_in") == 0)
    empty = c("name").rlike("Stub|Empty|Noop|NoOp|Dummy|Placeholder")
    caller = every(
        ~c("p_abstract"), ~is_word("pmods", "override") & ~F.contains("panns", F.lit("Override")), c("gkind") != "Interface", c("pkind") != "Constructor", ~c("p_convention"),
        ~F.contains("panns", F.lit("Composable")), ~c("pname").rlike("^on|Listener$|Callback$"), ~((c("pname") == "main") & c("p_main") & (c("p_params") <= 1)),
    )
    model = F.contains("supers", F.lit("ViewModel"))
    own_type = F.lower(F.element_at(F.split(F.regexp_replace("type_name", r"[<?].*$", ""), r"\."), -1))
    view = F.lower(F.regexp_replace("name", "^(_|my|m)", "")).isin([v.lower() for v in VIEWS]) | c("lname").isin([v.lower() for v in VIEWS])
    draw = c("lname").isin("ondraw", "dispatchdraw", "drawchild", "ondrawforeground", "ondrawshadow")
    composable = fun() & held("Composable")
    screen = low("screen", "page", "content", "view")
    person = low("detail", "profile", "user") & low("screen", "page", "content")
    logic = low("fetch", "load", "process", "validate", "calculate", "compute", "transform")
    no_test = c("source_set") != "test"
    hot = c("name").isin(HOT)
    iterates = low("foreach", "iterate", "loop", "process", "batch", "all")
    chained = sum(F.when(F.contains("lname", F.lit(w)), 1).otherwise(0) for w in SCOPE)
    leaky = prop() & low(*LEAKS)
    global_fun = fun() & c("name").rlike("GlobalScope|runBlocking")
    found = [
        ("DC001", dead, medium),
        ("DC001m", member & (c("n_in") == 0), medium),
        ("DC001p", ~c("is_live") & (debug | helper | deprecated | empty), F.when(debug | helper | deprecated, high).otherwise(medium)),
        ("DC002a", every(member, c("kind") == "Property", c("n_write") > 0, c("n_read") == 0), medium),
        ("DC002b", every(prop(), c("visibility") == "Private", ~c("name").rlike("^[A-Z_]*$"), ~c("name").startswith("_"), ~c("name").isin("binding", "viewModel", "adapter", "layoutManager"), c("n_write") >= 1, c("n_in") == c("n_write")), high),
        ("DC003", every(c("kind") == "Parameter", c("n_in") == 0, ~c("name").startswith("_"), ~c("name").isin("savedInstanceState", "context", "parent", "view"), ~c("is_muted"), caller), medium),
        ("DC005", every(c("kind") == "EnumCase", c("n_in") == 0, c("anns") == "", no_test, ~c("p_iterated")), medium),
        ("DC006", every(c("parent_id").isNull(), c("visibility") == "Public", c("language") == "Kotlin", c("kind").isin("Class", "Interface", "Object", "Enum", "Function", "Property"), c("anns") == "", c("n_modules") >= 2, c("n_in") > 0, c("n_foreign") == 0, ~c("is_root")), medium),
        ("DC008", every(c("kind").isin("Class", "Object"), c("of_sealed"), ~is_word("mods", "sealed", "enum"), c("n_use") == 0, (c("kind") == "Class") | (c("n_in") == 0)), high),
        ("DC009", every(c("kind") == "Method", is_word("mods", "override"), ~held("Deprecated", "Suppress", "VisibleForTesting"), c("n_out") == 0), low_),
        ("AP001", (c("kind") == "Object") & (c("c_mutable") >= 1), high),
        ("AP002", every(c("kind") == "Class", ~c("name").startswith("Base"), c("depth") >= x.depth), medium),
        ("AP003", every(c("kind") == "Interface", ~ends("name", "Fake", "Mock", "Stub", "Test", "Spy"), c("n_impl") == 1), medium),
        ("AP004", held("Subscribe") | every(c("kind") == "Class", ends("name", "Event"), ~c("name").rlike("Listener|Click|Touch|Lifecycle|State|Action|Intent")), F.when(held("Subscribe"), high).otherwise(medium)),
        ("AP007", every(c("kind") == "Class", model, (c("c_params") > x.model_params) | (c("c_own_methods") > x.model_methods) | (c("c_data") > 0)), medium),
        ("AP008", no_test & (global_fun | ((c("kind") == "Class") & F.contains("supers", F.lit("GlobalScope"))) | (prop() & F.contains("name", F.lit("GlobalScope")))), F.when(c("kind") == "Class", high).otherwise(medium)),
        ("AP009", c("c_lateinit") > x.lateinit, medium),
        ("AP010", fun() & (chained >= 3), low_),
        ("AP011", (leaky & (is_word("mods", "static") | (c("pkind") == "Object") | F.contains("pname", F.lit("Companion")))) | every(c("kind") == "Object", c("name").rlike("Holder|Cache|Manager"), c("c_leaks") > 0), F.when(c("kind") == "Object", high).otherwise(medium)),
        ("AP012", fun() & (c("lines") > x.method_lines), medium),
        ("AP013", (c("kind") == "Class") & ((c("c_methods") > x.class_methods) | (c("c_props") > x.class_props)), medium),
        ("AP014", every(fun(), low("process", "transform", "convert", "filter", "map") | F.lower("anns").rlike("query|transform"), c("bytes") >= 200), low_),
        ("AP015", every(c("kind") == "Method", c("bytes") >= 200, hot | (iterates & (c("bytes") > 400))), F.when(hot, medium).otherwise(low_)),
        ("AP016", every(prop(), c("visibility") != "Private", low(*MUTABLE)), F.when(F.lower("pname").contains("viewmodel") | F.lower("psupers").contains("viewmodel"), high).otherwise(medium)),
        ("AP017", every(prop(), c("p_model"), F.when(c("type_name") != "", own_type.isin([v.lower() for v in VIEWS])).otherwise(view)), F.when(c("type_name") != "", high).otherwise(medium)),
        ("AP018", every(c("kind") == "Class", model, c("c_repos") > x.repositories, c("c_usecases") == 0), medium),
        ("AP019", every(fun(), low("load", "fetch", "request", "async", "callback", "listener"), c("bytes") > 500), low_),
        ("AP020", every(fun(), ~F.lower("file").contains("test"), c("bytes") >= 100, low("fetch", "load", "async", "suspend", "launch", "with", "flow")), low_),
        ("AP021", every(fun(), c("language") == "Kotlin", c("bytes") > 100, low("null", "optional", "maybe", "unwrap", "force")), low_),
        ("AP022", every(fun(), c("language") == "Kotlin", no_test, c("bytes") >= 150, low("reflect", "kclass", "property", "member", "introspect", "dynamic")), low_),
        ("AP023", every(c("kind").isin("Method", "Function", "Constructor"), ~held("Inject"), c("c_params") > x.params), medium),
        ("AP024", every(fun(), c("bytes") >= 300, low("valid", "check", "verify", "should", "can", "is", "has", "^if")), low_),
        ("AP025", every(c("kind") == "Class", c("bytes") >= 500, low("preferences", "prefs", "intent", "bundle", "api", "endpoint", "constants", "keys"), c("c_companion") == 0), low_),
        ("AP026", every(fun(), c("bytes") > 150, low("cursor", "stream", "reader", "writer", "connection", "socket", "channel", "input", "output", "read", "write", "open", "query")), low_),
        ("AP027", every(c("kind") == "Method", F.lower("pname").contains("dao") | F.lower("panns").contains("dao"), ~is_word("mods", "suspend"), low("dao", "database", "query", "insert", "update", "delete", "repository", "sqlite", "room")), medium),
        ("AP028", every(c("kind") == "Method", c("bytes") >= 100, low("wakelock", "wake", "acquire", "power") | F.lower("pname").rlike("wakelock|power|service")), low_),
        ("AP029", (c("kind") == "Class") & F.contains("supers", F.lit("AsyncTask")), high),
        ("AP030", every(c("kind") == "Method", draw, c("bytes") >= 100), F.when(F.lower("pname").rlike("view|canvas|drawable") | c("psupers").rlike("View|Drawable"), medium).otherwise(low_)),
        ("AP031", every(composable, c("language") == "Kotlin", c("bytes") >= 100, low("screen", "content", "dialog", "sheet", "card", "item", "form", "input", "toggle", "counter")), low_),
        ("AP032", every(composable, c("bytes") >= 200, person | low("load", "fetch", "refresh")), F.when(person, medium).otherwise(low_)),
        ("AP033", every(composable, c("bytes") >= 200, logic | ((c("bytes") > 500) & screen)), F.when(logic, medium).otherwise(low_)),
        ("AP034", every(composable, screen, ~low("navhost", "navigation", "navgraph", "router", "root"), ~c("lname").isin("app", "main")), low_),
        ("V7", every(c("parent_id").isNull(), c("source_set") == "main", c("n_in") > 0, c("n_main") == 0), medium),
        ("V9", held("Deprecated"), F.when(c("n_in") == 0, high).otherwise(low_)),
        ("V10", every(c("kind").isin(TYPES), F.arrays_overlap(G.simple_supers(), F.array(*map(F.lit, WORKERS))), c("n_in") == 0), medium),
        ("V11", every(c("kind").isin(TYPES), held("Serializable"), c("n_in") == 0), medium),
    ]
    return [Rule(*f) for f in found]


def _child() -> dict[str, Column]:
    name = F.lower("name")
    return {
        "c_methods": fun(),
        "c_own_methods": c("kind") == "Method",
        "c_props": prop(),
        "c_params": c("kind") == "Parameter",
        "c_lateinit": prop() & is_word("mods", "lateinit") & ~held("Inject", "Autowired"),
        "c_repos": prop() & name.contains("repo"),
        "c_usecases": prop() & name.rlike("usecase|interactor"),
        "c_data": c("kind").isin("Property", "Parameter") & c("name").rlike("|".join(DATA)),
        "c_leaks": prop() & name.rlike("|".join(LEAKS)),
        "c_companion": (c("kind") == "Object") & (is_word("mods", "companion") | (c("name") == "Companion")),
        "c_mutable": every(c("kind") == "Property", ~c("visibility").isin("Private", "Internal"), ~F.contains("anns", F.lit("VisibleForTesting")), ~is_word("mods", "val", "const", "private_set")),
    }


def _into() -> dict[str, Column]:
    return {
        "n_in": F.lit(True),
        "n_write": c("kind") == "Write",
        "n_read": c("kind").isin("Read", "Call"),
        "n_use": c("kind").isin("Call", "Instantiation", "Reflection", "Type"),
        "n_foreign": c("s_module") != c("d_module"),
        "n_main": c("s_set") == "main",
    }


def _view_model() -> Column:
    supers = F.transform(G.simple_supers(), lambda s: F.lower(s))
    named = F.lower("name").rlike("(viewmodel|vm)$") | F.exists(supers, lambda s: s.endswith("viewmodel"))
    return (c("kind") == "Class") & named & ~F.arrays_overlap(supers, F.array(*map(F.lit, NOT_MODELS)))


def facts(decls: DataFrame, edges: DataFrame, roots: DataFrame, live: DataFrame, iterated: DataFrame | None = None) -> DataFrame:
    """One row a declaration with everything that rules ask.

    ``live`` is (node); ``iterated`` the (decl_id) of enums whose cases are listed by
    reflection, none if not given.
    """
    child = decls.where("parent_id is not null").groupBy(c("parent_id").alias("decl_id")).agg(*[F.count_if(p).alias(n) for n, p in _child().items()])
    place = lambda k: decls.select(c("decl_id").alias(k), c("module").alias(f"{k[0]}_module"), c("source_set").alias(f"{k[0]}_set"))
    e = edges.select("src", "dst", "kind").join(place("src"), "src").join(place("dst"), "dst")
    into = e.groupBy(c("dst").alias("decl_id")).agg(*[F.count_if(p).alias(n) for n, p in _into().items()])
    out = edges.groupBy(c("src").alias("decl_id")).agg(F.count(F.lit(1)).alias("n_out"))
    rooted = roots.select("decl_id").distinct().withColumn("is_root", F.lit(True))
    alive = live.select(c("node").alias("decl_id")).distinct().withColumn("is_live", F.lit(True))
    muted = decls.where(suppressed("anns", "unused", "UNUSED_PARAMETER")).select("decl_id")
    muted = G.with_members(muted, decls).select(c("node").alias("decl_id")).distinct().withColumn("is_muted", F.lit(True))
    sealed = decls.where(is_word("mods", "sealed")).select(c("name").alias("base")).distinct()
    bases = decls.where("supers <> ''").select("decl_id", "kind", F.explode(G.simple_supers()).alias("base"))
    of_sealed = bases.join(sealed, "base", "left_semi").select("decl_id").distinct().withColumn("of_sealed", F.lit(True))
    impls = bases.where("kind = 'Class'").groupBy(c("base").alias("name")).agg(F.count(F.lit(1)).alias("n_impl"))
    deep = G.inheritance_depth(decls.where("kind = 'Class' or kind = 'Interface'")).select(c("node").alias("decl_id"), "depth")
    main = (c("kind") == "Function") | ((c("kind") == "Method") & (is_word("mods", "static") | F.contains("anns", F.lit("JvmStatic"))))
    # parents are the declarations with children
    up = decls.join(child.select("decl_id", c("c_params").alias("p_params")), "decl_id").join(alive.withColumnRenamed("is_live", "p_live"), "decl_id", "left")
    if iterated is not None:
        up = up.join(iterated.select("decl_id").distinct().withColumn("p_iterated", F.lit(True)), "decl_id", "left")
    else:
        up = up.withColumn("p_iterated", F.lit(False))
    parent = up.join(decls.select(c("decl_id").alias("parent_id"), c("kind").alias("gkind")), "parent_id", "left").select(
        c("decl_id").alias("parent_id"), c("kind").alias("pkind"), c("name").alias("pname"), c("supers").alias("psupers"), c("anns").alias("panns"), c("mods").alias("pmods"),
        "gkind", "p_params", "p_live", "p_iterated", is_word("mods", "abstract").alias("p_abstract"), is_convention().alias("p_convention"), main.alias("p_main"), _view_model().alias("p_model"),
    )
    all_ = decls.join(parent, "parent_id", "left").join(impls, "name", "left")
    for part in (child, into, out, rooted, alive, muted, of_sealed, deep):
        all_ = all_.join(part, "decl_id", "left")
    modules = stash(decls.agg(F.count_distinct("module").alias("n_modules")))
    all_ = all_.join(F.broadcast(modules), F.lit(True))
    numbers = [*_child(), *_into(), "n_out", "n_impl", "depth", "p_params"]
    texts = ["pkind", "pname", "psupers", "panns", "pmods", "gkind"]
    flags = ["is_root", "is_live", "is_muted", "of_sealed", "p_live", "p_iterated", "p_abstract", "p_convention", "p_main", "p_model"]
    return all_.na.fill({n: 0 for n in numbers} | {n: "" for n in texts} | {n: False for n in flags}).withColumn("lname", F.lower("name"))


COLUMNS = ["code", "confidence", "decl_id", "name", "kind", "file", "line", "module", "source_set", "bytes"]


def evaluate(facts: DataFrame, chosen: list[Rule]) -> DataFrame:
    """Findings of all chosen rules: one scan of the facts, one row for each rule that holds."""
    held = [F.when(r.when, F.struct(F.lit(r.code).alias("code"), r.confidence.alias("confidence"))) for r in chosen]
    each = facts.withColumn("f", F.explode(F.array_compact(F.array(*held))))
    return each.select("f.code", "f.confidence", *COLUMNS[2:])
