import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "key"),
    [("@ohos.router.pushUrl(options: any): void", "@ohos.router.pushUrl"), ("@ohos.a->b-->c", "@ohos.a.b.c"), ("'@ohos.x#y'", "@ohos.x.y"), ("..@ohos..z.", "@ohos.z"), ("@ohos.m https://h/p", "@ohos.mhttps")],
)
def test_api_keys(spark, raw, key):
    assert one(spark, T.normalize_api_key(F.col("x")), x=raw) == key


def test_permission_tokens(spark):
    got = one(spark, T.extract_tokens(F.col("x")), x="ohos.permission.INTERNET（可选） 未识别 with ohos.permission.GET_NETWORK_INFO ohos.permission.INTERNET")
    assert got == ["ohos.permission.INTERNET", "ohos.permission.GET_NETWORK_INFO"]


def test_tokeniser_takes_longest_anchor_first(spark):
    got = one(spark, T.tokenise(F.col("x"), ["头像", "头像图片"]), x="收集头像图片和头像。")
    assert [(r.text, r.anchor) for r in got] == [("收集", False), ("头像图片", True), ("和", False), ("头像", True), ("。", False)]
    assert one(spark, T.tokenise(F.col("x"), ["甲"]), x="没有") == []


@pytest.mark.parametrize(("path", "title"), [("entry/src/main/ets/pages/LoginPage.ets", "登录页面"), ("ets/pages/my/Index.ets", "首页"), ("ets/pages/my/Foo.ets", "我的页面"), ("ets/pages/ChatPage.ets", "聊天页面"), ("ets/pages/首页.ets", "首页"), ("ets/pages/Foo.ets", "Foo页面"), ("", "页面页面")])
def test_page_titles(spark, path, title):
    assert one(spark, T.page_title(F.col("x")), x=path) in (title, "页面" if not path else title)


def test_lenient_json_and_titles(spark):
    assert one(spark, F.try_variant_get(T.lenient_json(F.col("x")), "$.a", "int"), x='noise {"a":1} tail') == 1
    assert one(spark, T.lenient_json(F.col("x")).isNull(), x="none")
    assert one(spark, T.short_title(F.col("x")), x=' “去 (登录)。” ') == "去（登录）"
    assert one(spark, T.is_low_quality(F.col("x")), x="功能入口")
    assert one(spark, T.is_low_quality(F.col("x")), x="Opens the page")
    assert not one(spark, T.is_low_quality(F.col("x")), x="查询天气时")
    assert one(spark, T.is_good_title(F.lit("Page"), F.col("x")), x="登录页面")
    assert not one(spark, T.is_good_title(F.lit("Page"), F.col("x")), x="登录")
    assert one(spark, T.action_of(F.col("x"), F.lit("")), x="@ohos.router.pushUrl") == "页面跳转"


def test_titles_of_elements(spark):
    from quarry.plans import ui

    code = ["Column() {", "Button($r('app.string.save'))", ".onClick(() => this.x())", *[""] * 12, "Image($r('app.media.ic_qrcode'))", *[""] * 12, "Text('ok')", *[""] * 12, "SearchBox()", *[""] * 12, "Row2()", *[""] * 12, "Foo()", ".onTouch(() => { this.pressToTalk() })", *[""] * 12, "Bar('entry/x.ets')"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(code, 1)], "path string, line_no int, line string")
    at = lambda x: next(i for i, c in enumerate(code, 1) if c.startswith(x))
    kinds = {"Button": "Button", "Image": "Display", "Text": "Display", "SearchBox": "Input", "Row2": "Component", "Foo": "Component", "Bar": "Button"}
    elements = spark.createDataFrame([("f", at(c), c, k) for c, k in kinds.items()], "path string, line int, component string, category string")
    strings = spark.createDataFrame([("save", "保存（文件）"), ("other", "别的")], "name string, value string")
    opening = spark.createDataFrame([("f", at("Bar"))], "path string, line int")
    want = {"Button": "保存（文件）", "Image": "扫一扫", "Text": "确定", "SearchBox": "搜索", "Row2": "功能入口", "Foo": "发送语音", "Bar": "进入页面"}
    assert {r.component: r.description for r in ui.element_titles(elements, lines, opening, strings).collect()} == want
    plain = {r.component: r.description for r in ui.element_titles(elements, lines, opening).collect()}
    assert plain == want | {"Button": "点击操作"}
