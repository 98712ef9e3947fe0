"""The rules once more as SQL, written from their descriptions and not from the conditions in ``rules``."""

from __future__ import annotations

from fathom.plans.graph_queries import DEEP
from fathom.plans.model import SQL


def _has(col: str, words: str) -> str:
    """One of the words, given with blanks between, is in the column."""
    return f"len(list_filter(string_split('{words}', ' '), lambda w: contains({col}, w))) > 0"


def _in(col: str, words: str) -> str:
    return f"list_contains(string_split('{words}', ' '), {col})"


def _mod(word: str, col: str = "mods") -> str:
    return f"list_contains(string_split({col}, ' '), '{word}')"


_SIMPLE = "list_last(string_split(split_part(split_part({0}, '<', 1), '(', 1), '.'))"
_VIEW = (
    "view textview button imagebutton imageview recyclerview edittext checkbox radiobutton switch seekbar progressbar webview viewgroup linearlayout relativelayout framelayout constraintlayout coordinatorlayout "
    "scrollview nestedscrollview cardview toolbar appbarlayout tablayout viewpager viewpager2 fragment dialogfragment bottomsheetdialogfragment activity fragmentactivity appcompatactivity componentactivity context "
    "dialog alertdialog bottomsheetdialog toast snackbar popupwindow popupmenu layoutinflater window drawable bitmap"
)
_SERIAL = "Serializable SerializedName JsonProperty JsonField Parcelize Parcelable Entity ColumnInfo PrimaryKey"
_LEAK = "context activity fragment view bitmap drawable handler dialog toast windowmanager"
_OPERATOR = "unaryPlus unaryMinus not inc dec plus minus times div rem plusAssign minusAssign timesAssign divAssign remAssign rangeTo rangeUntil contains get set invoke compareTo equals iterator hasNext next getValue setValue provideDelegate"
_WIRE = "Provides Binds BindsOptionalOf BindsInstance IntoMap IntoSet ElementsIntoSet Multibinds Inject AssistedInject AssistedFactory Factory Single KoinViewModel Query Insert Update Delete RawQuery Transaction GET POST PUT DELETE PATCH HEAD OPTIONS HTTP OnLifecycleEvent BindingAdapter InverseBindingAdapter BindingMethod BindingMethods BindingConversion Subscribe OnClick Preview"
_LIFE = "onCreate onStart onRestart onResume onPause onStop onDestroy onAttach onDetach onCreateView onViewCreated onDestroyView onActivityCreated onBind onUnbind onStartCommand onReceive onNewIntent onActivityResult onRequestPermissionsResult onSaveInstanceState onRestoreInstanceState onConfigurationChanged onLowMemory onTrimMemory"

HEAD = f"""WITH RECURSIVE {SQL}, {DEEP},
alive AS (SELECT DISTINCT node FROM deep),
mute AS (SELECT decl_id FROM decls WHERE contains(lower(anns), 'suppress(') AND contains(lower(anns), 'unused') UNION SELECT d.decl_id FROM decls d JOIN mute m ON d.parent_id = m.decl_id),
chain AS (SELECT DISTINCT d.name, b.base FROM decls d JOIN bases b USING (decl_id) WHERE d.kind IN ('Class', 'Interface') AND b.base IN (SELECT name FROM decls WHERE kind IN ('Class', 'Interface'))),
steps AS (SELECT DISTINCT name, 0 AS n FROM decls WHERE kind IN ('Class', 'Interface') UNION SELECT chain.name, n + 1 FROM chain JOIN steps ON chain.base = steps.name WHERE n < 16),
depths AS (SELECT name, max(n) AS depth FROM steps GROUP BY name),
kids AS (SELECT parent_id AS id, count_if(kind = 'Method' OR kind = 'Function') AS k_fun, count_if(kind = 'Method') AS k_method, count_if(kind = 'Property' OR kind = 'Field') AS k_prop, count_if(kind = 'Parameter') AS k_param,
  count_if((kind = 'Property' OR kind = 'Field') AND {_mod('lateinit')} AND NOT contains(anns, 'Inject') AND NOT contains(anns, 'Autowired')) AS k_late,
  count_if((kind = 'Property' OR kind = 'Field') AND lower(name) LIKE '%repo%') AS k_repo, count_if((kind = 'Property' OR kind = 'Field') AND (lower(name) LIKE '%usecase%' OR lower(name) LIKE '%interactor%')) AS k_case,
  count_if(kind IN ('Parameter', 'Property') AND ({_has('name', 'Database Retrofit SharedPreferences DataStore Dao ApiService HttpClient')})) AS k_data,
  count_if((kind = 'Property' OR kind = 'Field') AND ({_has('lower(name)', _LEAK)})) AS k_leak, count_if(kind = 'Object' AND (name = 'Companion' OR {_mod('companion')})) AS k_comp,
  count_if(kind = 'Property' AND visibility <> 'Private' AND visibility <> 'Internal' AND NOT contains(anns, 'VisibleForTesting') AND NOT {_mod('val')} AND NOT {_mod('const')} AND NOT {_mod('private_set')}) AS k_var
  FROM decls WHERE parent_id IS NOT NULL GROUP BY parent_id),
hits AS (SELECT dst AS id, count(*) AS refs, count_if(e.kind = 'Write') AS writes, count_if(e.kind = 'Read' OR e.kind = 'Call') AS reads, count_if(e.kind IN ('Instantiation', 'Call', 'Reflection', 'Type')) AS uses,
  count_if(a.module <> b.module) AS far, count_if(a.source_set = 'main') AS mains FROM edges e JOIN decls a ON a.decl_id = src JOIN decls b ON b.decl_id = dst GROUP BY dst),
d AS (SELECT x.*, lower(x.name) AS ln, coalesce(p.kind, '') AS pk, coalesce(p.name, '') AS pn, lower(coalesce(p.name, '')) AS pln, coalesce(p.supers, '') AS ps, coalesce(p.anns, '') AS pa, coalesce(p.mods, '') AS pm, coalesce(g.kind, '') AS gk,
  p.language AS plang, coalesce(refs, 0) AS refs, coalesce(writes, 0) AS writes, coalesce(reads, 0) AS reads, coalesce(uses, 0) AS uses, coalesce(far, 0) AS far, coalesce(mains, 0) AS mains,
  coalesce(kids.k_fun, 0) AS k_fun, coalesce(kids.k_method, 0) AS k_method, coalesce(kids.k_prop, 0) AS k_prop, coalesce(kids.k_param, 0) AS k_param, coalesce(kids.k_late, 0) AS k_late, coalesce(kids.k_repo, 0) AS k_repo, coalesce(kids.k_case, 0) AS k_case,
  coalesce(kids.k_data, 0) AS k_data, coalesce(kids.k_leak, 0) AS k_leak, coalesce(kids.k_comp, 0) AS k_comp, coalesce(kids.k_var, 0) AS k_var, coalesce(pk_.k_param, 0) AS p_params,
  x.decl_id IN (SELECT decl_id FROM roots) AS rooted, x.decl_id IN (SELECT node FROM alive) AS lives, coalesce(x.parent_id IN (SELECT node FROM alive), FALSE) AS p_lives, coalesce(depths.depth, 0) AS depth
  FROM decls x LEFT JOIN decls p ON p.decl_id = x.parent_id LEFT JOIN decls g ON g.decl_id = p.parent_id LEFT JOIN hits ON hits.id = x.decl_id LEFT JOIN kids ON kids.id = x.decl_id LEFT JOIN kids pk_ ON pk_.id = x.parent_id
  LEFT JOIN depths ON depths.name = x.name AND x.kind IN ('Class', 'Interface')),
q AS (SELECT *, language = 'Kotlin' AND kind IN ('Function', 'Method') AND ({_mod('operator')} OR regexp_matches(name, '^component[0-9]+$') OR ({_mod('override')} OR contains(anns, 'Override')) AND {_in('name', _OPERATOR)}) AS op,
  plang = 'Kotlin' AND pk IN ('Function', 'Method') AND ({_mod('operator', 'pm')} OR regexp_matches(pn, '^component[0-9]+$') OR ({_mod('override', 'pm')} OR contains(pa, 'Override')) AND {_in('pn', _OPERATOR)}) AS p_op FROM d),
f AS (SELECT *, op OR kind = 'Property' AND language = 'Kotlin' AND {_mod('const')}
  OR ({_has('anns', _SERIAL)}) OR kind IN ('Field', 'Property') AND (({_has('pa', _SERIAL)}) OR len(list_filter(string_split(ps, ' '), lambda s: list_contains(['Serializable', 'Parcelable', 'Externalizable'], {_SIMPLE.format('s')}))) > 0)
  OR kind IN ('Function', 'Method') AND {_in('name', 'writeToParcel describeContents createFromParcel newArray readFromParcel writeObject readObject readObjectNoData writeReplace readResolve')}
  OR kind IN ('Function', 'Method') AND pk = 'Class' AND language = 'Kotlin' AND {_mod('data', 'pm')} AND (name IN ('copy', 'equals', 'hashCode', 'toString') OR regexp_matches(name, '^component[0-9]+$'))
  OR {_mod('override')} OR contains(anns, 'Override') OR kind = 'Method' AND ps <> '' AND {_in('name', _LIFE)} OR contains(lower(anns), 'suppress("unused")') OR contains(anns, 'VisibleForTesting') OR ({_has('anns', 'Test Before After Rule')}) AS spared FROM q)"""

_FUN, _PROP = "kind IN ('Function', 'Method')", "kind IN ('Field', 'Property')"
_COMP = f"{_FUN} AND contains(anns, 'Composable')"
_MEMBER = f"lives AND NOT rooted AND parent_id IS NOT NULL AND p_lives AND kind NOT IN ('Class', 'Interface', 'Object', 'Constructor') AND NOT spared AND NOT ({_has('anns', _WIRE)}) AND NOT (visibility = 'Public' AND refs > 0)"
_DEBUG = "(contains(name, 'Debug') OR contains(file, '/debug/') OR contains(file, '/staging/'))"
_HELPER = f"(NOT contains(file, '/test/') AND NOT contains(file, '/androidTest/') AND {_has('name', 'Mock Fake Stub TestHelper TestUtil TestData ForTest InTest')})"
_OLD = "(contains(anns, 'Deprecated') AND refs = 0)"
_MODEL = "contains(supers, 'ViewModel')"
_PMODEL = f"""(pk = 'Class' AND (pln LIKE '%viewmodel' OR pln LIKE '%vm' OR len(list_filter(string_split(lower(ps), ' '), lambda s: {_SIMPLE.format('s')} LIKE '%viewmodel')) > 0)
  AND len(list_filter(string_split(lower(ps), ' '), lambda s: {_in(_SIMPLE.format('s'), 'fragment dialogfragment bottomsheetdialogfragment activity fragmentactivity appcompatactivity componentactivity service broadcastreceiver contentprovider view viewgroup recyclerview adapter')})) = 0)"""
_PERSON = f"(({_has('ln', 'detail profile user')}) AND {_has('ln', 'screen page content')})"
_LOGIC = _has("ln", "fetch load process validate calculate compute transform")
_HOT = _in("name", "onDraw onMeasure onLayout dispatchDraw draw onTouchEvent onInterceptTouchEvent onBindViewHolder onScrollChanged onScrolled onAnimationUpdate computeScroll")
_CHAIN = " + ".join(f"(ln LIKE '%{w}%')::INT" for w in ("let", "apply", "also", "run", "with", "takeif", "takeunless"))
_TYPE = "kind IN ('Class', 'Interface', 'Object', 'Enum', 'TypeAlias', 'Annotation')"

#: Code: (condition, confidence) over ``f``; limits as the registered queries have them.
RULES = {
    "DC001": (f"NOT lives AND kind <> 'Parameter' AND NOT spared AND NOT (parent_id IS NOT NULL AND NOT p_lives AND (kind = 'Constructor' OR pk IN ('Class', 'Interface', 'Object', 'Enum'))) AND NOT (kind = 'Constructor' AND visibility = 'Private' AND k_param = 0)", "'Medium'"),
    "DC001m": (f"{_MEMBER} AND refs = 0", "'Medium'"),
    "DC001p": (f"NOT lives AND ({_DEBUG} OR {_HELPER} OR {_OLD} OR {_has('name', 'Stub Empty Noop NoOp Dummy Placeholder')})", f"CASE WHEN {_DEBUG} OR {_HELPER} OR {_OLD} THEN 'High' ELSE 'Medium' END"),
    "DC002a": (f"{_MEMBER} AND kind = 'Property' AND writes > 0 AND reads = 0", "'Medium'"),
    "DC002b": (f"{_PROP} AND visibility = 'Private' AND NOT regexp_full_match(name, '[A-Z_]*') AND name[1] <> '_' AND NOT {_in('name', 'binding viewModel adapter layoutManager')} AND writes > 0 AND refs - writes = 0", "'High'"),
    "DC003": (f"kind = 'Parameter' AND refs = 0 AND name[1] <> '_' AND NOT {_in('name', 'savedInstanceState context parent view')} AND decl_id NOT IN (SELECT decl_id FROM mute) AND NOT {_mod('abstract', 'pm')} AND NOT {_mod('override', 'pm')} AND NOT contains(pa, 'Override') AND gk <> 'Interface' AND pk <> 'Constructor' AND NOT coalesce(p_op, FALSE) AND NOT contains(pa, 'Composable') AND pn NOT LIKE 'on%' AND pn NOT LIKE '%Listener' AND pn NOT LIKE '%Callback' AND NOT (pn = 'main' AND p_params <= 1 AND (pk = 'Function' OR pk = 'Method' AND ({_mod('static', 'pm')} OR contains(pa, 'JvmStatic'))))", "'Medium'"),
    "DC005": ("kind = 'EnumCase' AND refs = 0 AND length(anns) = 0 AND source_set <> 'test'", "'Medium'"),
    "DC006": ("parent_id IS NULL AND visibility = 'Public' AND language = 'Kotlin' AND kind IN ('Property', 'Function', 'Enum', 'Object', 'Interface', 'Class') AND length(anns) = 0 AND (SELECT count(DISTINCT module) FROM decls) > 1 AND refs > 0 AND far = 0 AND NOT rooted", "'Medium'"),
    "DC008": (f"kind IN ('Class', 'Object') AND NOT {_mod('sealed')} AND NOT {_mod('enum')} AND decl_id IN (SELECT b.decl_id FROM bases b JOIN decls s ON s.name = b.base WHERE {_mod('sealed', 's.mods')}) AND uses = 0 AND (kind = 'Class' OR refs = 0)", "'High'"),
    "DC009": (f"kind = 'Method' AND {_mod('override')} AND NOT ({_has('anns', 'Deprecated Suppress VisibleForTesting')}) AND decl_id NOT IN (SELECT src FROM edges)", "'Low'"),
    "AP001": ("kind = 'Object' AND k_var > 0", "'High'"),
    "AP002": ("kind = 'Class' AND NOT starts_with(name, 'Base') AND depth >= 3", "'Medium'"),
    "AP003": ("kind = 'Interface' AND NOT regexp_matches(name, '(Fake|Mock|Stub|Test|Spy)$') AND name IN (SELECT base FROM bases JOIN decls USING (decl_id) WHERE kind = 'Class' GROUP BY base HAVING count(*) = 1)", "'Medium'"),
    "AP004": (f"contains(anns, 'Subscribe') OR kind = 'Class' AND name LIKE '%Event' AND NOT ({_has('name', 'Listener Click Touch Lifecycle State Action Intent')})", "CASE WHEN contains(anns, 'Subscribe') THEN 'High' ELSE 'Medium' END"),
    "AP007": (f"kind = 'Class' AND {_MODEL} AND (k_param > 6 OR k_method > 6 OR k_data > 0)", "'Medium'"),
    "AP008": (f"source_set <> 'test' AND ({_FUN} AND (contains(name, 'GlobalScope') OR contains(name, 'runBlocking')) OR kind = 'Class' AND contains(supers, 'GlobalScope') OR {_PROP} AND contains(name, 'GlobalScope'))", "CASE kind WHEN 'Class' THEN 'High' ELSE 'Medium' END"),
    "AP009": ("k_late > 1", "'Medium'"),
    "AP010": (f"{_FUN} AND ({_CHAIN}) > 2", "'Low'"),
    "AP011": (f"{_PROP} AND ({_has('ln', _LEAK)}) AND ({_mod('static')} OR pk = 'Object' OR contains(pn, 'Companion')) OR kind = 'Object' AND ({_has('name', 'Holder Cache Manager')}) AND k_leak > 0", "CASE kind WHEN 'Object' THEN 'High' ELSE 'Medium' END"),
    "AP012": (f"{_FUN} AND bytes // 40 > 15", "'Medium'"),
    "AP013": ("kind = 'Class' AND (k_fun > 8 OR k_prop > 4)", "'Medium'"),
    "AP014": (f"{_FUN} AND (({_has('ln', 'process transform convert filter map')}) OR ({_has('lower(anns)', 'query transform')})) AND bytes // 40 >= 5", "'Low'"),
    "AP015": (f"kind = 'Method' AND bytes > 199 AND ({_HOT} OR bytes > 400 AND ({_has('ln', 'foreach iterate loop process batch all')}))", f"CASE WHEN {_HOT} THEN 'Medium' ELSE 'Low' END"),
    "AP016": (f"{_PROP} AND NOT visibility = 'Private' AND {_has('ln', 'mutablelivedata mutablestateflow mutablesharedflow mutablestate behaviorsubject publishsubject replaysubject')}", "CASE WHEN contains(pln, 'viewmodel') OR contains(lower(ps), 'viewmodel') THEN 'High' ELSE 'Medium' END"),
    "AP017": (f"{_PROP} AND {_PMODEL} AND CASE WHEN length(type_name) > 0 THEN {_in('lower(list_last(string_split(split_part(rtrim(type_name, chr(63)), chr(60), 1), chr(46))))', _VIEW)} ELSE len(list_filter(string_split('{_VIEW}', ' '), lambda v: ln IN (v, '_' || v, 'm' || v, 'my' || v))) > 0 END", "CASE WHEN length(type_name) > 0 THEN 'High' ELSE 'Medium' END"),
    "AP018": (f"kind = 'Class' AND {_MODEL} AND k_repo > 0 AND k_case = 0", "'Medium'"),
    "AP019": (f"{_FUN} AND bytes > 500 AND {_has('ln', 'load fetch request async callback listener')}", "'Low'"),
    "AP020": (f"{_FUN} AND NOT contains(lower(file), 'test') AND bytes > 99 AND {_has('ln', 'fetch load async suspend launch with flow')}", "'Low'"),
    "AP021": (f"{_FUN} AND language <> 'Java' AND bytes > 100 AND {_has('ln', 'null optional maybe unwrap force')}", "'Low'"),
    "AP022": (f"{_FUN} AND language <> 'Java' AND source_set <> 'test' AND bytes > 149 AND {_has('ln', 'reflect kclass property member introspect dynamic')}", "'Low'"),
    "AP023": ("kind IN ('Constructor', 'Function', 'Method') AND NOT contains(anns, 'Inject') AND k_param > 4", "'Medium'"),
    "AP024": (f"{_FUN} AND bytes > 299 AND (starts_with(ln, 'if') OR {_has('ln', 'valid check verify should can is has')})", "'Low'"),
    "AP025": (f"kind = 'Class' AND bytes > 499 AND k_comp = 0 AND {_has('ln', 'preferences prefs intent bundle api endpoint constants keys')}", "'Low'"),
    "AP026": (f"{_FUN} AND bytes > 150 AND {_has('ln', 'cursor stream reader writer connection socket channel input output read write open query')}", "'Low'"),
    "AP027": (f"kind = 'Method' AND (contains(pln, 'dao') OR contains(lower(pa), 'dao')) AND NOT {_mod('suspend')} AND {_has('ln', 'dao database query insert update delete repository sqlite room')}", "'Medium'"),
    "AP028": (f"kind = 'Method' AND bytes > 99 AND (({_has('ln', 'wakelock wake acquire power')}) OR {_has('pln', 'wakelock power service')})", "'Low'"),
    "AP029": ("kind = 'Class' AND supers LIKE '%AsyncTask%'", "'High'"),
    "AP030": (f"kind = 'Method' AND {_in('ln', 'ondraw dispatchdraw drawchild ondrawforeground ondrawshadow')} AND bytes > 99", f"CASE WHEN ({_has('pln', 'view canvas drawable')}) OR ps LIKE '%View%' OR ps LIKE '%Drawable%' THEN 'Medium' ELSE 'Low' END"),
    "AP031": (f"{_COMP} AND language <> 'Java' AND bytes > 99 AND {_has('ln', 'screen content dialog sheet card item form input toggle counter')}", "'Low'"),
    "AP032": (f"{_COMP} AND bytes > 199 AND ({_PERSON} OR {_has('ln', 'load fetch refresh')})", f"CASE WHEN {_PERSON} THEN 'Medium' ELSE 'Low' END"),
    "AP033": (f"{_COMP} AND bytes > 199 AND ({_LOGIC} OR bytes > 500 AND ({_has('ln', 'screen page view content')}))", f"CASE WHEN {_LOGIC} THEN 'Medium' ELSE 'Low' END"),
    "AP034": (f"{_COMP} AND ({_has('ln', 'screen page content view')}) AND NOT ({_has('ln', 'navhost navigation navgraph router root')}) AND ln <> 'app' AND ln <> 'main'", "'Low'"),
    "V7": ("parent_id IS NULL AND source_set = 'main' AND refs > 0 AND mains = 0", "'Medium'"),
    "V9": ("contains(anns, 'Deprecated')", "CASE refs WHEN 0 THEN 'High' ELSE 'Low' END"),
    "V10": (f"{_TYPE} AND refs = 0 AND decl_id IN (SELECT decl_id FROM bases WHERE {_in('base', 'Worker CoroutineWorker ListenableWorker RxWorker JobService JobIntentService')})", "'Medium'"),
    "V11": (f"{_TYPE} AND refs = 0 AND contains(anns, 'Serializable')", "'Medium'"),
}

COLUMNS = "decl_id, name, kind, file, line, module, source_set, bytes"


def findings_sql(*codes: str) -> str:
    """All findings of the rules, as one SELECT after ``HEAD``."""
    return " UNION ALL ".join(f"SELECT '{k}' AS code, {RULES[k][1]} AS confidence, {COLUMNS} FROM f WHERE {RULES[k][0]}" for k in codes or RULES)
