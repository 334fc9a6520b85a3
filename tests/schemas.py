"""Schemas for the tests, written with the builder."""

from wirelake.schema import EnumDef, FieldDef, FileDef, MessageDef, build

F = FieldDef

SCALARS = ["int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "float", "double", "bool", "string", "bytes"]

PROTO3 = FileDef(
    "t3.proto",
    "t3",
    [
        MessageDef(
            "All",
            [F("f_" + s, i + 1, s) for i, s in enumerate(SCALARS)]
            + [F("r_" + s, i + 101, s, repeated=True) for i, s in enumerate(SCALARS)]
            + [F("o_" + s, i + 201, s, optional=True) for i, s in enumerate(SCALARS)]
            + [
                F("child", 16, "message:All"),
                F("kids", 17, "message:Leaf", repeated=True),
                F("leaf", 18, "message:Leaf"),
                F("color", 19, "enum:Color"),
                F("colors", 20, "enum:Color", repeated=True),
                F("counts", 21, "map:string,int32"),
                F("leaves", 22, "map:int64,message:Leaf"),
                F("flags", 23, "map:bool,enum:Color"),
                F("pick_int", 24, "int32", oneof="pick"),
                F("pick_text", 25, "string", oneof="pick"),
                F("pick_leaf", 26, "message:Leaf", oneof="pick"),
                F("loose", 27, "int32", repeated=True, packed=False),
            ],
        ),
        MessageDef("Flat", [F("f_" + s, i + 1, s) for i, s in enumerate(SCALARS)] + [F("r_" + s, i + 101, s, repeated=True) for i, s in enumerate(SCALARS)] + [F("o_" + s, i + 201, s, optional=True) for i, s in enumerate(SCALARS)] + [F("kids", 17, "message:Leaf", repeated=True), F("leaf", 18, "message:Leaf"), F("color", 19, "enum:Color"), F("colors", 20, "enum:Color", repeated=True), F("counts", 21, "map:string,int32"), F("leaves", 22, "map:int64,message:Leaf"), F("flags", 23, "map:bool,enum:Color"), F("pick_int", 24, "int32", oneof="pick"), F("pick_text", 25, "string", oneof="pick"), F("pick_leaf", 26, "message:Leaf", oneof="pick"), F("loose", 27, "int32", repeated=True)]),
        MessageDef("Leaf", [F("id", 1, "int32"), F("name", 2, "string"), F("tags", 3, "string", repeated=True)]),
    ],
    [EnumDef("Color", {"RED": 0, "GREEN": 1, "BLUE": 2, "DARK": -1})],
)

PROTO2 = FileDef(
    "t2.proto",
    "t2",
    [
        MessageDef(
            "Old",
            [
                F("need", 1, "int32", required=True, default="7"),
                F("name", 2, "string", default="x\\ty"),
                F("kind", 3, "enum:Kind"),
                F("kinds", 4, "enum:Kind", repeated=True),
                F("by_key", 5, "map:string,enum:Kind"),
                F("box", 6, "group:Box"),
                F("boxes", 7, "group:Boxes", repeated=True),
                F("packed", 8, "sint32", repeated=True, packed=True),
            ],
            messages=[MessageDef("Box", [F("a", 1, "int32")]), MessageDef("Boxes", [F("b", 1, "string")])],
            extension_ranges=[(100, 200)],
        ),
        MessageDef("Set", [], extension_ranges=[(4, 1000)], message_set=True),
    ],
    [EnumDef("Kind", {"Z": 0, "A": 1, "B": 2})],
    extensions=[("Old", F("ext_int", 100, "int32")), ("Old", F("ext_old", 101, "message:Old")), ("Old", F("ext_list", 102, "sint64", repeated=True, packed=True)), ("Set", F("in_set", 10, "message:Old"))],
    services={"Find": [("Get", "Old", "Old", False, True)]},
    syntax="proto2",
)

SET = build(PROTO3, PROTO2)
