"""The graph's data model: node and edge tables, the write contract, and fixed lookups."""

from __future__ import annotations

from pyspark.sql import types as T

NODE_SCHEMA = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "node_type", "path", "name", "meta", "origin_file")])
EDGE_SCHEMA = T.StructType([T.StructField(x, T.StringType()) for x in ("src", "dst", "edge_type", "field_path", "operation", "meta", "origin_file")])

# Id prefix of each node type.
NODE_PREFIX = {"Page": "page:", "Component": "comp:", "Model": "model:", "Field": "field:", "Action": "action:", "Condition": "cond:"}
#: Field nodes also stand for symbols.
SYMBOL_PREFIXES = ("param:", "user:", "system:")

# Allowed endpoint pairs of each edge type that is emitted.
ENDPOINTS = {
    "Contains": [("Page", "Component"), ("Component", "Component"), ("Model", "Field")],
    "Triggers": [("Component", "Action")],
    "Reads": [("Component", "Model"), ("Component", "Field")],
    "Writes": [("Component", "Model")],
    "FieldWrite": [("Component", "Field"), ("Action", "Field")],
    "ActionWrites": [("Action", "Model")],
    "ActionReads": [("Action", "Model"), ("Action", "Field")],
    "ActionNavigates": [("Action", "Page")],
    "PassesParam": [("Action", "Field")],
    "ActionSetsParam": [("Action", "Field")],
    "ActionControlsComponent": [("Action", "Component")],
    "ActionValidates": [("Action", "Model")],
    "ActionLoadsData": [("Action", "Model"), ("Action", "Component")],
    "EmbedsPage": [("Component", "Page")],
    "DependsOn": [("Component", "Component"), ("Component", "Field"), ("Condition", "Component"), ("Condition", "Action"), ("Condition", "Model"), ("Condition", "Field")],
    "DataflowInput": [("Model", "Model")],
    "DataflowOutput": [("Model", "Model")],
    "OutputsTo": [("Model", "Model")],
    "FieldAlias": [("Field", "Field")],
}
# Declared edge types that are never emitted; one that is emitted is a violation.
NEVER_EMITTED = ("OpensPage", "SetsParam", "DataflowInternal")
EDGE_TYPES = (*ENDPOINTS, *NEVER_EMITTED)

# Category of each action type; any other type is "unknown".
ACTION_CATEGORY = {
    "submitData": "data_write", "insertData": "data_write", "updateData": "data_write", "deleteData": "data_write",
    "loadData": "data_read", "link": "navigation", "showDialog": "navigation", "setParamValue": "param_mutation",
    "showComponent": "ui_control", "hideComponent": "ui_control", "switchPanel": "ui_control", "closeDialog": "ui_control",
    "validateData": "validation", "newData": "data_initialization", "resetData": "data_refresh", "refreshModels": "data_refresh",
    "refreshData": "data_refresh", "script": "script_execution", "webAPI": "api_call", "showMessage": "message_prompt", "showFilesGallary": "file_gallery",
}

# Condition type of a property that holds a condition; any other property is a FieldExp.
CONDITION_TYPE = {
    "visibleCondition": "VisibleCondition", "visible": "VisibleCondition", "enable": "EnableCondition", "disableCondition": "EnableCondition",
    "conditionExp": "ActionConditionExp", "condition": "ActionCondition", "itemFilter": "ItemFilter", "calcCondition": "CalcCondition",
    "validExp": "ValidExp", "calcExp": "CalcExp", "maskCondition": "MaskCondition", "submitCondition": "SubmitCondition",
    "submitPageCondition": "SubmitPageCondition", "defaultPanelCondition": "DefaultPanelCondition", "defaultValue": "DefaultValueExp", "defaultValueExp": "DefaultValueExp",
}
# Effect of a condition type.
EFFECT_TYPE = {
    "VisibleCondition": "Show", "EnableCondition": "Enable", "ActionConditionExp": "Execute", "ActionCondition": "Execute",
    "ItemFilter": "Filter", "SourceFilterExp": "Filter", "SourceFilterClause": "Filter", "CalcCondition": "Compute", "CalcExp": "Compute",
    "FieldExp": "Compute", "DefaultValueExp": "Compute", "ValidExp": "Validate", "MaskCondition": "Mask", "SubmitCondition": "Submit",
    "SubmitPageCondition": "Submit", "DefaultPanelCondition": "DefaultPanel",
}

# Properties that are always expressions, and those that are if they begin with "=" or hold "${".
ALWAYS_EXPRESSION = ("exp", "itemFilter", "visibleCondition", "validExp", "calcCondition", "calcExp", "maskCondition", "submitCondition", "submitPageCondition", "defaultPanelCondition", "disableCondition", "defaultValueExp")
MAYBE_EXPRESSION = (
    "value", "defaultValue", "visible", "enable", "text", "formula", "html", "desc", "placeholder", "url", "documentTitle", "inputTitle", "labelValue",
    "panelName", "rootPath", "selectedCaption", "confirmCaption", "tip", "badge", "count", "attrCaption", "caption", "defaultSelect", "defaultCheck", "maxLevel",
)

# Forward and reverse weight of an edge type for each retrieval intent; others weigh nothing.
INTENT_WEIGHTS = {
    "writer": {"FieldAlias": (0.8, 0.8), "FieldWrite": (0.15, 1.0), "Writes": (0.15, 1.0), "ActionWrites": (0.15, 1.0), "Triggers": (0.1, 0.1), "ActionReads": (0.1, 0.1), "Contains": (0.02, 0.02)},
    "value_source": {"Reads": (1.0, 0.25), "FieldAlias": (0.9, 0.9), "DependsOn": (0.9, 0.25), "DataflowInput": (0.8, 0.8), "DataflowInternal": (0.8, 0.8), "DataflowOutput": (0.8, 0.8), "OutputsTo": (0.8, 0.8), "Contains": (0.02, 0.02)},
    "availability": {"Reads": (1.0, 0.25), "FieldAlias": (0.85, 0.85), "DependsOn": (0.9, 0.25), "DataflowInput": (0.85, 0.85), "DataflowInternal": (0.85, 0.85), "DataflowOutput": (0.85, 0.85), "OutputsTo": (0.85, 0.85), "ActionLoadsData": (0.85, 0.85), "Contains": (0.02, 0.02)},
    "display": {"DependsOn": (1.0, 0.8), "ActionControlsComponent": (1.0, 0.8), "Triggers": (0.1, 0.1), "Contains": (0.02, 0.02)},
    "action": {"Triggers": (1.0, 0.2), "ActionReads": (0.8, 0.35), "ActionWrites": (0.8, 0.35), "FieldWrite": (0.8, 0.35), "ActionNavigates": (0.9, 0.4), "ActionSetsParam": (0.9, 0.4), "ActionControlsComponent": (0.9, 0.4), "ActionValidates": (0.9, 0.4), "ActionLoadsData": (0.9, 0.4), "DependsOn": (0.8, 0.2), "Contains": (0.02, 0.02)},
    "context": {"Contains": (0.05, 0.05), "EmbedsPage": (0.1, 0.1)} | {k: (0.5, 0.5) for k in EDGE_TYPES if k not in ("Contains", "EmbedsPage")},
}
# Edge types that a causal path may use.
CAUSAL_EDGES = ("Reads", "Writes", "ActionReads", "ActionWrites", "DependsOn", "Contains", "DataflowInput", "DataflowInternal", "DataflowOutput", "FieldAlias", "FieldWrite", "Triggers")
WRITE_EDGES = ("Writes", "ActionWrites")
STRUCTURE_EDGES = ("Contains", "Triggers")
