"""Meaning of actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ACTION_CATEGORY


def category(action_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ACTION_CATEGORY.items() for x in pair])[action_type], F.lit("unknown"))


# What an action does, {c} being its component and {t} its targets; where two are given, the second one is
# for an action without a known target.
SENTENCES = {
    "submitData": ("点击 {c} 后提交数据到 {t}", "点击 {c} 后提交数据（未识别目标字段）"),
    "insertData": ("点击 {c} 后向 {t} 插入新记录", "点击 {c} 后插入新记录（未识别目标模型）"),
    "updateData": ("点击 {c} 后更新 {t} 的记录", "点击 {c} 后更新记录（未识别目标模型）"),
    "deleteData": ("点击 {c} 后删除 {t} 的记录", "点击 {c} 后删除记录（未识别目标模型）"),
    "link": ("点击 {c} 后跳转到 {t}", "点击 {c} 后跳转（未识别目标页面）"),
    "setParamValue": ("点击 {c} 后设置页面参数",),
    "showDialog": ("点击 {c} 后打开对话框",),
    "closeDialog": ("点击 {c} 后关闭对话框",),
    "switchPanel": ("点击 {c} 后切换面板",),
    "showComponent": ("点击 {c} 后显示组件",),
    "hideComponent": ("点击 {c} 后隐藏组件",),
    "validateData": ("点击 {c} 后校验数据",),
    "newData": ("点击 {c} 后新建数据",),
    "loadData": ("点击 {c} 后加载数据",),
    "resetData": ("点击 {c} 后重置数据",),
    "refreshModels": ("点击 {c} 后刷新模型",),
    "refreshData": ("点击 {c} 后刷新数据",),
    "script": ("点击 {c} 后执行脚本（具体副作用需人工确认）",),
    "webAPI": ("点击 {c} 后调用接口",),
    "showMessage": ("点击 {c} 后显示消息提示",),
    "showFilesGallary": ("点击 {c} 后打开附件/文件预览",),
}
# A sentence for any other type {a}.
OTHER_SENTENCE = "点击 {c} 后执行 {a} 动作"
# Second parts of a reference that name a property of a component and not an action.
PROPERTIES = ("value", "text", "checked", "selected", "visible", "disabled", "readonly", "hidden")
PROPERTY_REASON = "second part looks like a component property, not an action id"
# Component types that hold others, and those that take input.
CONTAINERS = ("dialog", "panel", "embedsuperpage", "form")
INPUTS = ("input", "textarea", "select", "radio", "checkbox", "datePicker", "number", "search")


def _filled(form: str, **parts: Column) -> Column:
    """A form with its {names} replaced by columns."""
    out = []
    for k, piece in enumerate(form.replace("}", "{").split("{")):
        if piece:
            out.append(parts[piece] if k % 2 else F.lit(piece))
    return F.concat(*out)


def sentence(action_type: Column, component: Column, targets: Column) -> Column:
    """What an action does, in a sentence; targets: written fields of submitData, models of the other writes, pages of link."""
    joined = F.array_join(targets, ", ")
    out = None
    for kind, forms in SENTENCES.items():
        text = _filled(forms[0], c=component, t=joined)
        if len(forms) == 2:
            text = F.when(F.size(targets) > 0, text).otherwise(_filled(forms[1], c=component))
        out = F.when(action_type == kind, text) if out is None else out.when(action_type == kind, text)
    return out.otherwise(_filled(OTHER_SENTENCE, c=component, a=action_type))


def wait_previous(raw: Column) -> Column:
    """(raw, component_id, action_id, resolved, reason) of the action that one waits for: ``component.action``."""
    parts = F.split(raw, "\\.")
    two = F.size(parts) == 2
    prop = two & F.get(parts, F.lit(1)).isin(*PROPERTIES)
    return F.struct(
        raw.alias("raw"),
        F.when(two, F.get(parts, F.lit(0))).alias("component_id"),
        F.when(two & ~prop, F.get(parts, F.lit(1))).alias("action_id"),
        F.coalesce(two & ~prop, F.lit(False)).alias("resolved"),
        F.when(prop, F.lit(PROPERTY_REASON)).alias("reason"),
    )


def importance(node_type: Column, kind: Column, navigates: Column, writes: Column, reads: Column, acts: Column) -> Column:
    """What part a node plays on its page, by its type, its component type and whether it navigates, writes, reads and has actions."""
    data = F.when(writes, "action_target").when(reads, "data_source_display")
    component = (
        F.when(kind.isin(*CONTAINERS), "container").when(kind.isin(*INPUTS), "form_input").when((kind == "text") & reads, "data_source_display").when(acts, "entrypoint")
        .otherwise(F.coalesce(data, F.lit("static_display")))
    )
    return (
        F.when(node_type == "Page", F.when(navigates | writes, "entrypoint").otherwise("container"))
        .when(node_type == "Component", component)
        .when(node_type == "Action", F.when(navigates, "entrypoint").otherwise(F.coalesce(data, F.lit("static_display"))))
        .when(node_type.isin("Model", "Field"), F.coalesce(data, F.lit("unknown")))
        .when(node_type == "Condition", "condition")
    )
