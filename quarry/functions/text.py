"""Scalar functions over text columns. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "未识别"
PERMISSION = r"ohos\.permission\.[A-Za-z0-9_]+"
#: Titles of usual page names.
PAGE_TITLES = {
    "index": "首页", "home": "首页", "main": "首页", "entry": "首页", "chat": "聊天", "message": "聊天", "messages": "聊天",
    "contact": "通讯录", "contacts": "通讯录", "addressbook": "通讯录", "discover": "发现", "find": "发现", "moment": "朋友圈",
    "moments": "朋友圈", "timeline": "朋友圈", "mine": "我的", "me": "我", "my": "我的", "profile": "我的", "setting": "设置",
    "settings": "设置", "search": "搜索", "login": "登录", "register": "注册", "qrcode": "二维码", "qr": "二维码", "scan": "扫一扫",
}
#: Titles of what the system calls, by kind of file; {page} is the page's title.
LIFECYCLE_TITLES = {
    "onCreate": "应用创建时", "onDestroy": "应用退出时", "onForeground": "应用切到前台时", "onBackground": "应用切到后台时", "onWindowStageCreate": "主窗口创建时",
    "onWindowStageDestroy": "主窗口销毁时", "onWindowStageActive": "主窗口激活时", "onWindowStageInactive": "主窗口失焦时", "onNewWant": "收到新请求时", "onConfigurationUpdate": "系统配置更新时",
}
COMPONENT_TITLES = {"build": "组件展示与交互", "aboutToAppear": "组件显示时", "aboutToDisappear": "组件隐藏前", "onBackPress": "组件返回处理"}
PAGE_EVENT_TITLES = {"build": "展示与交互", "aboutToAppear": "进入时", "aboutToDisappear": "离开前", "onPageShow": "显示时", "onPageHide": "隐藏时", "onBackPress": "返回处理"}
#: Scenario texts that say nothing.
GENERIC_SCENARIOS = ("功能入口", "页面主布局容器", "页面展示与交互", "组件展示与交互", "页面展示时", "组件展示时", "相关功能处理过程中", "相关功能处理时", "相关操作时")
#: Words of the framework that say nothing to a user.
FRAMEWORK = r"ArkUI|UIAbility|WindowStage|生命周期函数|(?<![A-Za-z0-9_])(?:build|onDestroy|onForeground|onBackground)(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])onWindowStage"
#: What a call does, by the first rule that fits: words of the API key, words of the description, action.
ACTIONS = (
    (("hasdefaultnet",), ("default data network",), "检查网络连接状态"),
    (("startbackgroundrunning",), ("start running in background",), "请求后台持续运行"),
    (("stopbackgroundrunning",), ("stop running in background",), "停止后台持续运行"),
    (("requestpermissionsfromuser",), ("permissions from the user",), "请求系统权限"),
    ((), ("location changed",), "监听位置变化"),
    (("@ohos.sensor.on",), ("accelerometer", "sensor data"), "监听传感器数据"),
    (("pushurl", "replaceurl"), ("页面跳转", "jump page"), "页面跳转"),
    ((), ("location",), "获取或监听位置信息"),
    ((), ("network",), "检查网络状态"),
)


#: Signs that a scenario's key lacks.
GENERIC_SIGNS = r"""(?U)[“”"'`、，,。.!！？?；;：:\-_\s]+"""
#: First words of an English description and what the call does.
FIRST_WORDS = (("subscribe", "订阅系统事件"), ("unsubscribe", "取消订阅系统事件"), ("checks?", "检查系统状态"), ("loads?", "加载相关内容"), ("starts?", "启动相关功能"), ("stops?", "停止相关功能"))


def trim_all(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_api_key(c: Column) -> Column:
    """Dotted API key: signature, url tail, quotes and white space off, arrows and # as dots."""
    s = F.substring_index(trim_all(c), "(", 1)
    for old, new in (("-->", "."), ("->", "."), ("#", "."), ("'", ""), ('"', ""), ("`", "")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(F.substring_index(s, "://", 1), r"(?U)\s+", "")
    return F.regexp_replace(F.regexp_replace(s, r"\.{2,}", "."), r"^\.+|\.+$", "")


def compose_description(action: Column, detail: Column, permission: Column, data: Column, data_detail: Column) -> Column:
    """``action / detail; 权限: permission; 数据: data / detail``; parts that are null or empty are left out."""
    part = lambda sep, *cs: F.nullif(F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in cs]), F.lit(""))
    return F.concat_ws("; ", part(" / ", action, detail), F.concat(F.lit("权限: "), part("", permission)), F.concat(F.lit("数据: "), part(" / ", data, data_detail)))


def uniq(array: Column) -> Column:
    """Distinct non-empty strings, the first occurrence kept."""
    return F.array_distinct(F.filter(array, lambda x: x.isNotNull() & (x != "")))


def extract_tokens(c: Column, pattern: str = PERMISSION) -> Column:
    """Distinct matches in order of appearance; hints in full-width brackets are dropped first."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "（[^）]*）", "")
    return uniq(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)))


def clean_text(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(clean_text(c), F.lit("")), F.lit(UNKNOWN))


def has_cjk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[一-鿿]")


def short_title(c: Column) -> Column:
    """Quotes and white space off, brackets full width, punctuation off at both ends."""
    t = F.translate(clean_text(c), "“”\"’'", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[（(]\s*", "（"), r"\s*[）)]", "）")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", ""), "^[：:，,。.!！？?]+|[：:，,。.!！？?]+$", "")


def is_noise(c: Column) -> Column:
    """Texts that are no title: empty, over 40 characters, or with signs of paths, files and permissions."""
    t = trim_all(F.coalesce(c, F.lit("")))
    return (t == "") | (F.length(t) > 40) | t.rlike(r"[/\\]|@ohos|ohos\.permission|\.ets|\.ts")


def is_framework_scenario(c: Column) -> Column:
    return c.rlike(FRAMEWORK)


def is_english_like(c: Column) -> Column:
    t = clean_text(c)
    words, cjk = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z0-9-]*"), F.lit(0))), F.size(F.regexp_extract_all(t, F.lit("[一-鿿]"), F.lit(0)))
    return (~has_cjk(t) & t.rlike("[A-Za-z]")) | ((words >= 4) & (cjk <= 2))


def is_low_quality(c: Column) -> Column:
    """Empty, generic, framework words or English-like."""
    t = clean_text(c)
    bare = F.lower(F.regexp_replace(t, GENERIC_SIGNS, ""))
    return (t == "") | (bare == "") | bare.isin(*GENERIC_SCENARIOS) | is_framework_scenario(t) | is_english_like(t)


def action_of(api_key: Column, description: Column) -> Column:
    """What a call does, from the first rule that its key or description fits; empty if none does."""
    key, desc = F.lower(clean_text(api_key)), F.lower(clean_text(description))
    out = None
    for keys, words, action in ACTIONS:
        fits = F.lit(False)
        for k in keys:
            fits = fits | F.contains(key, F.lit(k))
        for w in words:
            fits = fits | F.contains(desc, F.lit(w))
        out = F.when(fits, action) if out is None else out.when(fits, action)
    for word, action in FIRST_WORDS:
        out = out.when(desc.rlike(rf"^{word}(?![a-z0-9_])"), action)
    return out.otherwise("")


def scenario_of(feature_title: Column, page_title: Column, api_key: Column, description: Column) -> Column:
    """A feature's title if it says something, else page and action, else a generic text."""
    feature, page, action = clean_text(feature_title), clean_text(page_title), action_of(api_key, description)
    named = F.when(action != "", F.concat(page, action, F.lit("时"))).otherwise(F.concat(page, F.lit("相关功能处理时")))
    return F.when(~is_low_quality(feature), feature).when(~is_low_quality(page), named).when(action != "", F.concat(action, F.lit("时"))).otherwise("相关功能处理过程中")


def page_title(path: Column) -> Column:
    """Title of a page from its path: the segments after the last ``pages``, file ending and Page/View/Screen/Ability off.

    The last two segments, then all from the end: one with a CJK sign as it is, a known name by PAGE_TITLES, a camel-case name by
    its known parts; else the last segment as it is. A title ends in 页, 页面, 界面 or 主页.
    """
    table = F.create_map(*[F.lit(x) for kv in PAGE_TITLES.items() for x in kv])
    parts = F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    bare = F.transform(parts, lambda x: F.regexp_replace(x, r"\.(ets|ts|tsx|js|jsx)$", ""))
    at = F.size(bare) - F.array_position(F.reverse(F.transform(bare, F.lower)), "pages") + 1
    after = F.when(F.array_contains(F.transform(bare, F.lower), "pages"), F.slice(bare, at + 1, F.size(bare))).otherwise(bare)
    names = F.reverse(F.transform(after, lambda x: F.regexp_replace(x, "(Page|View|Screen|Ability)$", "")))

    def known(x: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), r"(?U)\s+"), lambda w: w != "")
        said = F.array_join(F.filter(F.transform(words, lambda w: F.try_element_at(table, F.lower(w))), lambda w: w.isNotNull()), "")
        return F.when(has_cjk(x), x).otherwise(F.coalesce(F.try_element_at(table, F.lower(x)), F.when(F.size(words) > 1, F.nullif(said, F.lit("")))))

    first = F.filter(F.transform(F.slice(names, 1, 2), known), lambda x: x.isNotNull())
    rest = F.filter(F.transform(names, lambda x: F.try_element_at(table, F.lower(x))), lambda x: x.isNotNull())
    base = short_title(F.coalesce(F.try_element_at(first, F.lit(1)), F.try_element_at(rest, F.lit(1)), F.nullif(F.try_element_at(names, F.lit(1)), F.lit("")), F.lit("页面")))
    base = F.coalesce(F.nullif(base, F.lit("")), F.lit("页面"))
    return F.when((base == "首页") | base.rlike("(页|页面|界面|主页)$"), base).otherwise(F.concat(base, F.lit("页面")))


def path_file(path: Column) -> Column:
    """A path with slashes in lower case, as the tests of its kind see it."""
    return F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))


def page_description(description: Column, path: Column) -> Column:
    """A page's own description if it is Chinese without Latin words, else its title by its path."""
    d = trim_all(F.coalesce(description, F.lit("")))
    return F.when(has_cjk(d) & ~d.rlike("[A-Za-z]{3,}"), d).otherwise(page_title(path))


def source_title(function: Column, path: Column, page: Column) -> Column:
    """Title of a feature that begins where the system calls: by the file's kind and the function's name; ``page`` is the page's description."""
    fn, file = trim_all(F.coalesce(function, F.lit(""))), path_file(path)
    known = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), fn)
    other = lambda head, bare: F.when(fn != "", F.concat(head, fn)).otherwise(bare)
    app = F.coalesce(known(LIFECYCLE_TITLES), other(F.lit("应用生命周期："), F.lit("应用生命周期")))
    part = F.coalesce(known(COMPONENT_TITLES), other(F.lit("组件逻辑："), F.lit("组件逻辑")))
    own = F.coalesce(F.concat(page, known(PAGE_EVENT_TITLES)), other(F.concat(page, F.lit("逻辑：")), F.concat(page, F.lit("逻辑"))))
    return F.when(file.rlike("(?:^|/)entryability/"), app).when(file.rlike("(?:^|/)component/"), part).otherwise(own)


def feature_title(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def category_of(component: Column) -> Column:
    return F.when(component == "Button", "Button").when(component.isin("TextInput", "TextArea", "Search"), "Input").when(component.isin("Text", "Image"), "Display").otherwise("Component")


def is_good_title(category: Column, title: Column) -> Column:
    """A title people can read: short, no component or file names, pages ending as pages do."""
    t, raw = short_title(title), F.coalesce(title, F.lit(""))
    named = raw.rlike(r"(?<![A-Za-z0-9_])(Button|TextInput|TextArea|Search|Column|Row|List|Image|Text|struct)(?![A-Za-z0-9_])")
    labelled = trim_all(raw).rlike(r"^(页面|输入框|显示元素|可点击元素|UI元素|UI)\s*[：:]")
    page = (category != "Page") | (t == "首页") | t.rlike("(页|页面|界面|主页)$")
    latin = raw.rlike(r"(Page|View|Screen)(?![A-Za-z0-9_])") & ~has_cjk(raw)
    return (t != "") & (F.length(t) <= F.when(category == "Page", 16).otherwise(24)) & ~labelled & ~named & ~latin & ~raw.rlike(r"\.ets|\.ts|desc:") & page


def path_class(path: Column) -> Column:
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return F.when(F.contains(p, F.lit("/pages/")), "page").when(F.contains(p, F.lit("/component")), "component").when(F.contains(p, F.lit("/entryability/")), "ability").otherwise("other")


def stable_id(prefix: str, *parts: Column, digits: int = 12) -> Column:
    """``prefix:`` and the first hex digits of the SHA-1 of the parts."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, digits))


def slug(c: Column) -> Column:
    """Letters, digits, underscores and hyphens; all else as one underscore, none at the ends, no two in a row."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), "_+", "_")


def route_key(c: Column) -> Column:
    """A route as files are known by: without a slash before and the file's ending behind."""
    u = F.regexp_replace(trim_all(c), "^/", "")
    return F.regexp_replace(F.regexp_replace(u, r"\.ets$", ""), r"\.ts$", "")


def file_route(path: Column) -> Column:
    """What a file is routed by: its path below the last ``/src/main/ets/``, without its ending."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^.*/src/main/ets/", ""), r"\.(ets|ts)$", "")


def absolute_path(c: Column) -> Column:
    """An absolute path with ``.`` and ``..`` resolved; null unless it begins with a slash."""
    p = F.replace(trim_all(c), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.when(p.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/")))


def limit_number(c: Column) -> Column:
    """A limit typed in: its whole part, 1 at least; null where it is no number."""
    n = F.floor(trim_all(c).try_cast("double")).cast("long")
    return F.when(n < 1, F.lit(1).cast("long")).otherwise(n)


def cut_list(array: Column, most: int) -> Column:
    """(items, cut): the first ``most`` items and whether there were more."""
    return F.struct(F.slice(array, 1, most).alias("items"), (F.size(array) > most).alias("cut"))


def clamp_text(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def lenient_json(c: Column) -> Column:
    """A variant: the text parsed as JSON, else its part from the first { to the last }; null if neither works."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))))


def visible_strings(c: Column) -> Column:
    """Texts of 1 to 60 characters in single, double or back quotes."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"""(["'`])((?:(?!\1)[^\n\\]){1,60})\1"""), F.lit(2)), lambda x: x != "")


def resource_ids(c: Column) -> Column:
    return uniq(F.regexp_extract_all(c, F.lit(r"""\$r\(\s*["']([^"']+)["']"""), F.lit(1)))


def handler_names(c: Column) -> Column:
    """Names called from event lines such as ``.onClick(() => this.save())``."""
    return uniq(F.regexp_extract_all(c, F.lit(r"\.on[A-Z][A-Za-z]*\s*\([^\n]*?this\s*\.\s*([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def element_title(category: Column, texts: Column, handlers: Column, icon: Column, url: Column | None = None) -> Column:
    """Visible text, then handler, icon and target, by category; else the category's default."""
    text = F.try_element_at(F.filter(texts, lambda x: ~is_noise(x)), F.lit(1))
    handler = F.try_element_at(handlers, F.lit(1))
    target = F.lit(None).cast("string") if url is None else F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("跳转"), page_title(url)))
    default = F.when(category == "Button", "按钮").when(category == "Input", "输入").when(category == "Display", "展示").otherwise("组件")
    return short_title(F.when(category == "Button", F.coalesce(text, target, handler, icon)).when(category == "Display", F.coalesce(text, icon, target)).otherwise(F.coalesce(text, handler, target, icon, default)))


#: What parts of a handler's and of an icon's name say, the first that occurs; titles of short English texts; defaults by category.
HANDLERS = (("search", "搜索"), ("send", "发送"), ("press+talk", "发送语音"), ("press+voice", "发送语音"), ("talk", "语音"), ("voice", "语音"), ("record", "语音"), ("scan", "扫一扫"), ("qrcode", "扫一扫"), ("qr", "扫一扫"), ("login", "登录"), ("register", "注册"), ("back", "返回"), ("setting", "设置"))
ICONS = (("search", "搜索"), ("add", "添加"), ("plus", "添加"), ("emoji", "表情"), ("camera", "拍照"), ("shoot", "拍照"), ("qrcode", "扫一扫"), ("qr", "扫一扫"), ("back", "返回"), ("setting", "设置"), ("location", "位置"), ("voice", "语音"), ("mic", "语音"), ("record", "语音"), ("keyboard", "键盘"))
SHORT_TEXTS = {"go": "进入", "ok": "确定", "cancel": "取消", "send": "发送", "search": "搜索"}
DEFAULTS = {"Input": "输入", "Button": "点击操作", "Display": "显示内容"}
OPENS, OTHER = "进入页面", "功能入口"


def named_by(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The title of the first entry whose parts all occur in a name; null without one."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for parts, title in reversed(table):
        hit = F.lit(True)
        for part in parts.split("+"):
            hit = hit & F.contains(low, F.lit(part))
        out = F.when(hit, title).otherwise(out)
    return out


def first_said(names: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The first title that any of several names gives."""
    return F.try_element_at(F.filter(F.transform(names, lambda n: named_by(n, table)), lambda t: t.isNotNull()), F.lit(1))


def quoted_texts(c: Column) -> Column:
    """Texts of 1 to 60 characters in single or double quotes, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"""(["'])([^'"]{1,60})\1"""), F.lit(2)), lambda x: F.trim(x)), lambda x: x != "")


def event_names(c: Column) -> Column:
    """Names behind ``this`` in the lines of a text that set an event's handler."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike("on(?:Click|Touch|Change|Submit|Action|KeyEvent|Gesture)"))
    return uniq(F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(r"\bthis\s*\.\s*([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1)))


def visible_text(texts: Column) -> Column:
    """Of several texts the first Chinese one as a title, else the first short English one as people say it, else nothing."""
    titles = F.filter(F.transform(texts, short_title), lambda t: (t != "") & ~is_noise(t))
    chinese = F.try_element_at(F.filter(titles, has_cjk), F.lit(1))
    english = F.try_element_at(F.filter(titles, lambda t: t.rlike("^[A-Za-z0-9]{1,10}$")), F.lit(1))
    known = F.create_map(*[F.lit(x) for kv in SHORT_TEXTS.items() for x in kv])
    return F.coalesce(chinese, F.try_element_at(known, F.lower(english)), english)


def inferred_title(category: Column, component: Column, said: Column, resources: Column, strings: Column, opens: Column) -> Column:
    """An element's title: a text of its string resources or its code and context, then what its handlers and icons are called, then that it opens a page, else its category's default.

    ``said`` is its line and the lines around, ``resources`` the ids that they name, ``strings`` the texts of those that are string resources.
    """
    text = visible_text(F.concat(strings, quoted_texts(said)))
    handler = first_said(event_names(said), HANDLERS)
    icon = first_said(resources, ICONS)
    search = F.when(F.contains(F.lower(component), F.lit("search")), "搜索")
    default = F.lit(OTHER)
    for kind, title in DEFAULTS.items():
        default = F.when(category == kind, title).otherwise(default)
    other = F.coalesce(text, handler, icon, F.when(opens, OPENS), default)
    title = short_title(F.when(category == "Input", F.coalesce(text, handler, search, default)).otherwise(other))
    return F.when(title != "", title).otherwise(F.when(category == "Input", "输入").otherwise("功能"))


#: Names in programs and what people call them.
IDENTIFIERS = {"currentlocation": "当前位置", "startposition": "起始位置", "isstart": "计步状态", "stepgoal": "步数目标", "build": "页面构建入口", "foreground": "前台状态", "background": "后台状态"}


def identifier_label(c: Column) -> Column:
    """What people call a name from a program, ``this.`` before it or not; null for others."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)\s+", "")), r"^this\.", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in IDENTIFIERS.items() for x in kv]), bare)


def user_text(c: Column) -> Column:
    """A text as people read it: known names as they call them, ``name（中文）`` as 中文, Latin text in brackets off where the rest is Chinese."""
    t = clean_text(c)
    hint = clean_text(F.regexp_extract(t, r"^[A-Za-z_$][\w$.]*\s*[（(]\s*([^()（）]*[一-鿿][^()（）]*)\s*[）)]$", 1))
    rest = clean_text(F.when(has_cjk(t), F.regexp_replace(t, r"\s*[（(]\s*[^()（）]*[A-Za-z][^()（）]*\s*[）)]", "")).otherwise(t))
    return F.when(t.isin("", UNKNOWN), t).otherwise(F.coalesce(identifier_label(t), F.nullif(hint, F.lit("")), identifier_label(rest), F.nullif(rest, F.lit("")), t))


def user_texts(array: Column) -> Column:
    return uniq(F.transform(array, user_text))


def first_text(*columns: Column) -> Column:
    """The first that isn't null or blank, without white space at its ends."""
    return F.coalesce(*[F.nullif(trim_all(c), F.lit("")) for c in columns])


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def app_name(path: Column) -> Column:
    """The last part of an app's path."""
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(path, r"[\\/]+$", ""), r"([^\\/]*)$", 1), F.lit("")), F.lit("app"))


def permission_sentence(scenario: Column, label: Column, purpose: Column, deny: Column) -> Column:
    """The report's sentence about one permission."""
    head = F.when(clean_text(scenario) != "", F.concat(F.lit("在“"), clean_text(scenario), F.lit("”场景中，我们会调用"))).otherwise("我们会调用")
    tail = F.when(clean_text(purpose) != "", F.concat(F.lit("，用于"), clean_text(purpose), F.lit("。"))).otherwise("。")
    end = F.when(clean_text(deny) != "", F.concat(F.lit("若您拒绝授权，"), clean_text(deny), F.lit("。"))).otherwise("")
    return F.concat(head, label, tail, end)


def tokenise(c: Column, anchors: list[str]) -> Column:
    """Array of (text, anchor): the text cut at anchors, the longest first; empty without any anchor in it."""
    if not anchors:
        return F.array().cast("array<struct<text:string,anchor:boolean>>")
    quoted = "|".join(r"\Q" + a.replace(r"\E", r"\E\\E\Q") + r"\E" for a in sorted(set(anchors), key=lambda a: (-len(a), a)))
    parts = F.regexp_extract_all(c, F.lit(f"(?s)(?:{quoted})|(?:(?!{quoted}).)+"), F.lit(0))
    told = F.transform(parts, lambda x: F.struct(x.alias("text"), x.isin(*anchors).alias("anchor")))
    return F.when(F.exists(told, lambda x: x.anchor), told).otherwise(F.array().cast("array<struct<text:string,anchor:boolean>>"))
