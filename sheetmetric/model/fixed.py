"""Fixed values.

Every table below states values that results depend on (keyword lists, weights,
lookup tables, patterns, thresholds).  They are part of the query semantics, in
priority order, and are not computed.
"""

# --- Fixed values: layer roles, in priority order -------------------------------
ROLE_KEYWORDS = [
    ("FRAME", ["图框", "图签", "会签", "FRAME", "TITLE", "BORDER", "TB-"]),
    ("AXIS", ["轴线", "轴网", "AXIS", "GRID", "DOTE"]),
    ("ANNOTATION", ["标注", "尺寸", "文字", "注释", "说明", "引线", "表格", "表", "图例",
                    "DIM", "TEXT", "NOTE", "LEADER", "SCHEDULE", "LEGEND", "TABLE"]),
    ("FILL", ["填充", "剖面线", "HATCH", "SOLID", "GRADIENT"]),
    ("AUXILIARY", ["辅助", "构造线", "参照", "AUX", "DEFPOINTS", "CONSTRUCTION"]),
    ("MEASURABLE", ["A-WALL", "A-DOOR", "A-WIND", "A-GLAZ", "A-COLS", "A-STRS", "A-ROOF", "A-FLOR", "A-CLNG",
                    "S-COLS", "S-COLUMN", "S-BEAM", "S-SLAB", "S-FOUN", "S-REBAR", "S-WALL", "S-STRS",
                    "P-PIPE", "P-FIXT", "P-VALVE", "P-SANIT", "P-EQUIP",
                    "H-DUCT", "H-PIPE", "M-DUCT", "H-EQUIP",
                    "E-LIGHT", "E-POWER", "E-CABLE", "E-SOCKET", "E-PANEL", "E-EQUIP",
                    "C-ROAD", "C-PIPE", "C-DRAIN",
                    "L-PLANT", "L-TREE", "L-SHRUB", "L-GRASS", "L-PAVE", "L-WATER",
                    "墙体", "门窗", "钢筋", "管道", "给水", "排水", "消防", "暖通", "风管", "桥架", "电缆",
                    "苗木", "乔木", "灌木", "草坪", "灯具"]),
]
EXCLUDED_ROLES = ["FRAME", "AXIS", "ANNOTATION", "FILL", "AUXILIARY"]

# --- Fixed values: disciplines ---------------------------------------------------
DISCIPLINE_ORDER = ["总图", "建筑", "结构", "给排水", "消防", "暖通", "电气", "智能建筑", "装饰", "建筑节能", "电梯", "其他"]
DRAWING_NO_PREFIX = [
    ("建施", "建筑"), ("JZ", "建筑"), ("JS", "建筑"), ("A", "建筑"),
    ("结施", "结构"), ("JG", "结构"), ("GS", "结构"), ("S", "结构"),
    ("水施", "给排水"), ("SS", "给排水"), ("PS", "给排水"), ("P", "给排水"), ("水", "给排水"),
    ("暖施", "暖通"), ("NS", "暖通"), ("M", "暖通"), ("通施", "暖通"), ("TS", "暖通"),
    ("电施", "电气"), ("DS", "电气"), ("E", "电气"), ("强电", "电气"), ("弱电", "电气"),
    ("设施", "给排水"), ("FS", "给排水"), ("装施", "装饰"), ("ZS", "装饰"), ("DE", "装饰"),
    ("总图", "总图"), ("总", "总图"), ("L", "总图"), ("Z", "总图"),
    ("消施", "消防"), ("XF", "消防"), ("消防", "消防"), ("智施", "智能建筑"), ("智能", "智能建筑"),
]
NAME_KEYWORDS = [
    ("建筑", ["建施", "建筑", "平面", "立面", "剖面", "门窗", "楼梯", "卫生间", "厨房", "阳台"]),
    ("结构", ["结施", "结构", "柱", "梁", "板", "基础", "钢筋", "承台", "剪力墙", "配筋", "平法"]),
    ("给排水", ["水施", "给排水", "给水", "排水", "雨水", "污水", "消火栓", "喷淋", "管道", "阀门", "地漏", "水泵"]),
    ("暖通", ["暖施", "暖通", "风管", "风口", "空调", "风机", "冷媒", "冷凝水", "排烟", "新风", "采暖"]),
    ("电气", ["电施", "电气", "照明", "插座", "开关", "配电箱", "桥架", "电缆", "防雷", "接地", "强电", "弱电", "回路"]),
    ("消防", ["消防", "火灾报警", "喷淋", "消火栓", "烟感", "温感"]),
    ("总图", ["总平面", "红线", "道路", "绿化", "坐标", "竖向", "场地"]),
    ("装饰", ["装饰", "装修", "地面", "墙面", "天花", "饰面"]),
    ("智能建筑", ["智能", "弱电", "监控", "门禁", "网络", "综合布线"]),
]
LAYER_KEYWORDS = [
    ("建筑", ["墙", "门", "窗", "WALL", "DOOR", "建"]),
    ("结构", ["柱", "梁", "板", "COLUMN", "BEAM", "结"]),
    ("给排水", ["水", "PIPE", "DRAIN", "WATER", "排"]),
    ("电气", ["灯", "插座", "ELEC", "LIGHT", "电"]),
    ("暖通", ["风", "DUCT", "HVAC", "暖"]),
]
CONTENT_WEIGHTS = {
    "建筑": {
        "layer": {"墙": 3, "门": 3, "窗": 3, "轴线": 3, "楼梯": 3, "房间": 2, "标高": 2, "WALL": 3, "DOOR": 3,
                  "WINDOW": 3, "AXIS": 3, "STAIR": 3, "FLOOR": 2, "ARCH": 2, "建": 2},
        "block": {"门": 3, "窗": 3, "楼梯": 3, "洁具": 2, "家具": 2, "DOOR": 3, "WINDOW": 3},
        "text": {"平面图": 3, "立面图": 3, "剖面图": 3, "房间": 2, "卫生间": 2, "办公室": 2, "会议室": 2, "走廊": 2,
                 "建筑面积": 3}},
    "结构": {
        "layer": {"柱": 3, "梁": 3, "板": 3, "基础": 3, "钢筋": 3, "承台": 3, "剪力墙": 3, "COLUMN": 3, "BEAM": 3,
                  "SLAB": 3, "REBAR": 3, "FOUND": 3, "STRU": 2},
        "block": {"柱": 3, "梁": 3, "桩": 3, "COLUMN": 3, "BEAM": 3},
        "text": {"配筋": 3, "混凝土": 2, "钢筋": 3, "结构": 3, "承台": 3, "梁平法": 3}},
    "给排水": {
        "layer": {"给水": 3, "排水": 3, "雨水": 3, "污水": 3, "消火栓": 3, "喷淋": 3, "管道": 3, "阀门": 3, "地漏": 3,
                  "WATER": 3, "DRAIN": 3, "PIPE": 3, "PLUMB": 2, "SPRINK": 3},
        "block": {"阀门": 3, "地漏": 3, "消火栓": 3, "喷头": 3, "水泵": 3, "洁具": 2},
        "text": {"给水": 3, "排水": 3, "DN": 3, "管径": 3, "消火栓": 3, "喷淋": 3, "给排水": 3, "系统图": 2}},
    "电气": {
        "layer": {"照明": 3, "插座": 3, "开关": 3, "配电箱": 3, "桥架": 3, "电缆": 3, "防雷": 3, "接地": 3, "LIGHT": 3,
                  "POWER": 3, "SOCKET": 3, "ELEC": 3, "CABLE": 3, "TRAY": 3},
        "block": {"灯具": 3, "插座": 3, "开关": 3, "配电箱": 3, "LIGHT": 3, "SOCKET": 3},
        "text": {"照明": 3, "插座": 3, "配电": 3, "电气": 3, "BV": 3, "YJV": 3, "回路": 3, "配电箱": 3, "强电": 3,
                 "弱电": 3}},
    "暖通": {
        "layer": {"风管": 3, "风口": 3, "空调": 3, "风机": 3, "冷媒": 3, "冷凝水": 3, "保温": 2, "DUCT": 3, "AHU": 3,
                  "FCU": 3, "HVAC": 3},
        "block": {"风口": 3, "风机": 3, "空调": 3, "阀": 2, "DUCT": 3},
        "text": {"风管": 3, "风口": 3, "空调": 3, "暖通": 3, "排烟": 3, "新风": 3, "冷负荷": 3, "风量": 3}},
    "总图": {
        "layer": {"红线": 3, "道路": 3, "绿化": 3, "坐标": 3, "场地": 3, "竖向": 3, "REDLINE": 3, "ROAD": 3, "SITE": 3},
        "block": {"指北针": 3, "坐标": 3, "树": 2, "车": 2},
        "text": {"总平面": 3, "红线": 3, "坐标": 3, "道路": 3, "绿化": 3, "竖向": 3}},
    "装饰": {
        "layer": {"地面": 3, "墙面": 3, "天花": 3, "踢脚": 3, "造型": 3, "饰面": 3, "FLOOR": 2, "CEILING": 3, "DECO": 3},
        "block": {"家具": 3, "灯具": 2, "洁具": 2, "饰面": 3},
        "text": {"装饰": 3, "装修": 3, "地面": 3, "墙面": 3, "天花": 3, "材料表": 3}},
}
CODE_KEYWORDS = [
    ("ARCH", ["墙", "门", "窗", "轴线", "楼梯", "房间", "WALL", "DOOR", "WINDOW", "AXIS", "平面图"]),
    ("STR", ["柱", "梁", "板", "基础", "钢筋", "承台", "剪力墙", "COLUMN", "BEAM", "SLAB", "REBAR"]),
    ("PLUMB", ["给水", "排水", "雨水", "污水", "消火栓", "喷淋", "管道", "阀门", "地漏", "WATER", "DRAIN", "PIPE", "DN"]),
    ("ELEC", ["照明", "插座", "开关", "配电箱", "桥架", "电缆", "防雷", "接地", "LIGHT", "POWER", "SOCKET", "BV", "YJV"]),
    ("HVAC", ["风管", "风口", "空调", "风机", "冷媒", "冷凝水", "保温", "DUCT", "AHU", "FCU", "排烟", "新风"]),
    ("SITE", ["红线", "道路", "绿化", "坐标", "场地", "竖向", "REDLINE", "ROAD", "总平面"]),
    ("DECO", ["地面", "墙面", "天花", "踢脚", "造型", "饰面", "装修", "装饰", "CEILING"]),
]
CODE_HIT_WEIGHT = {"layer": 3, "block": 3, "text": 2}
LAYER_PREFIX_WEIGHT = 5
LAYER_PREFIX_CODES = [
    ("WALL", "ARCH"), ("DOOR", "ARCH"), ("WINDOW", "ARCH"), ("AXIS", "ARCH"),
    ("COLUMN", "STR"), ("BEAM", "STR"), ("SLAB", "STR"), ("REBAR", "STR"),
    ("LIGHT", "ELEC"), ("SOCKET", "ELEC"), ("POWER", "ELEC"), ("ELEC", "ELEC"),
    ("WATER", "PLUMB"), ("DRAIN", "PLUMB"), ("PIPE", "PLUMB"), ("DUCT", "HVAC"), ("HVAC", "HVAC"),
    ("A", "ARCH"), ("AR", "ARCH"), ("ARCH", "ARCH"),
    ("S", "STR"), ("ST", "STR"), ("STR", "STR"), ("GS", "STR"),
    ("P", "PLUMB"), ("PL", "PLUMB"), ("PLUMB", "PLUMB"),
    ("M", "HVAC"), ("HV", "HVAC"), ("E", "ELEC"), ("EL", "ELEC"),
    ("L", "SITE"), ("LA", "SITE"), ("SITE", "SITE"),
]
# registry: code, name, unit work, acceptance standard
DISCIPLINE_REGISTRY = [
    ("ARCH", "建筑", "建筑与装饰工程", "GB50300"),
    ("STRU", "结构", "结构工程", "GB50300"),
    ("PLUMB", "给排水", "给排水工程", "GB50300"),
    ("HVAC", "暖通", "通风空调工程", "GB50300"),
    ("ELEC", "电气", "电气工程", "GB50300"),
    ("INTELL", "智能化", "智能建筑工程", "GB50300"),
    ("ELEV", "电梯", "电梯工程", "GB50300"),
    ("ENERGY", "建筑节能", "建筑节能工程", "GB50300"),
    ("MUNI", "市政", "市政工程", "MUNICIPAL"),
    ("LAND", "园林", "园林绿化工程", "LANDSCAPE"),
    ("STEEL", "钢结构", "钢结构工程", "GB50300"),
    ("UNKNOWN", "未识别", "未分类工程", "OTHER"),
]
DRAWING_TYPES = [
    ("SITE_PLAN", ["总平面", "SITE PLAN", "红线"]),
    ("SYSTEM_DIAGRAM", ["系统图", "SYSTEM DIAGRAM", "系统流程"]),
    ("DETAIL", ["大样", "节点", "详图", "DETAIL"]),
    ("SECTION", ["剖面", "SECTION"]),
    ("ELEVATION", ["立面", "ELEVATION"]),
    ("FLOOR_PLAN", ["平面", "PLAN", "FLOOR"]),
    ("SCHEDULE", ["表", "SCHEDULE", "清单"]),
]

# --- Fixed values: component categories --------------------------------------------
CATEGORIES = [
    ("WALL", ["墙", "WALL", "剪力墙"]), ("DOOR", ["门", "DOOR"]), ("WINDOW", ["窗", "WINDOW"]),
    ("COLUMN", ["柱", "COLUMN", "KZ", "GZ"]), ("BEAM", ["梁", "BEAM", "KL", "LL"]), ("SLAB", ["板", "SLAB", "楼板"]),
    ("STAIR", ["楼梯", "STAIR", "LT"]), ("AXIS", ["轴线", "AXIS"]), ("DIMENSION", ["标注", "DIM", "尺寸"]),
    ("TEXT", ["文字", "TEXT", "TXT", "注释"]), ("HATCH", ["填充", "HATCH", "剖面线"]), ("VALVE", ["阀", "VALVE"]),
    ("PIPE", ["管道", "PIPE", "给水", "排水", "WATER", "DRAIN"]), ("DUCT", ["风管", "DUCT", "风道"]),
    ("EQUIPMENT", ["设备", "EQUIP", "机组", "水泵", "风机", "空调", "AHU", "FCU"]),
    ("LIGHT", ["灯", "LIGHT", "照明", "LAMP"]), ("SOCKET", ["插座", "SOCKET"]), ("SWITCH", ["开关", "SWITCH"]),
    ("PANEL", ["配电箱", "配电柜", "PANEL", "POWER_BOX"]), ("CABLE", ["桥架", "电缆", "CABLE", "TRAY", "线槽"]),
    ("FURNITURE", ["家具", "FURNITURE", "桌椅"]), ("SANITARY", ["洁具", "马桶", "洗手盆", "SANITARY", "WC"]),
]
EXCLUDED_PRECEDING = {"板": "钢铁铜铝木皮垫脚", "门": "阀闸炉", "梁": "抬挑", "柱": "支顶"}
SUB_CATEGORIES = [
    ("GATE_VALVE", ["闸阀", "Z41", "Z15"]), ("BUTTERFLY_VALVE", ["蝶阀", "D71", "D37"]),
    ("CHECK_VALVE", ["止回阀", "H41", "H44"]), ("GLOBE_VALVE", ["截止阀", "J41", "J11"]),
    ("FIRE_HYDRANT", ["消火栓", "室内消火栓"]), ("SPRINKLER", ["喷头", "喷淋头"]),
    ("WATER_PUMP", ["水泵", "给水泵", "排水泵"]), ("FAN", ["风机", "排风机", "送风机"]),
    ("AHU", ["空调机组", "AHU"]), ("FCU", ["风机盘管", "FCU"]), ("LED_PANEL", ["LED", "面板灯"]),
    ("FLUORESCENT", ["荧光灯", "日光灯"]), ("SOCKET_5HOLE", ["五孔", "5孔"]), ("SOCKET_3HOLE", ["三孔", "3孔"]),
]
NO_TOPOLOGY_CATEGORIES = ["TEXT", "DIMENSION", "AXIS", "UNKNOWN"]
WALL_LAYER_KEYWORDS = ["墙", "WALL", "Q-", "剪力墙", "隔墙"]
LEGEND_TITLES = ["图例", "图 例", "LEGEND", "符号表", "图例表", "说明", "设计说明"]

# --- Fixed values: units, paper, scale ------------------------------------------------
INSUNITS = {0: "unitless", 1: "inch", 2: "ft", 4: "mm", 5: "cm", 6: "m"}
UNIT_FACTOR_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "inch": 25.4, "ft": 304.8, "unitless": 1.0}
RULE_UNIT_SCALE = {"mm": 1000.0, "cm": 100.0, "m": 1.0, "inch": 39.37, "ft": 3.28}
UNIT_NAMES = {
    0: "Unitless(无单位)", 1: "Inches(英寸)", 2: "Feet(英尺)", 3: "Miles(英里)", 4: "Millimeters(毫米)",
    5: "Centimeters(厘米)", 6: "Meters(米)", 7: "Kilometers(千米)", 8: "Microinches(微英寸)", 9: "Mils(密尔)",
    10: "Yards(码)", 11: "Angstroms(埃)", 12: "Nanometers(纳米)", 13: "Microns(微米)", 14: "Decimeters(分米)",
    15: "Decameters(十米)", 16: "Hectometers(百米)", 17: "Gigameters", 18: "Astronomical(天文单位)",
    19: "Light years(光年)", 20: "Parsecs(秒差距)",
}
PAPERS = [("A0", 1189, 841), ("A1", 841, 594), ("A2", 594, 420), ("A3", 420, 297), ("A4", 297, 210)]
PAPER_SCALES = [1, 10, 20, 50, 100, 200, 500, 1000]
RATIO_TOLERANCE = 0.05
ASPECT_TOLERANCE = 0.05
MODEL_MIN_FRAME_LONG_MM = 2378
POINT_MM = 25.4 / 72.0
VECTOR_TEXT_CHARS = 20
LARGE_FILE_MB = 50
LARGE_ENTITY_COUNT = 50000
DIMENSION_KINDS = {0: "线性/旋转", 1: "对齐", 2: "角度", 3: "直径", 4: "半径", 5: "角度3点", 6: "坐标"}

# --- Fixed values: text patterns ---------------------------------------------------------
SCALE_PATTERN = r"(?<![\d.])1\s*[:：]\s*(\d+(?:\.\d+)?)"
ELEVATION_PATTERN = r"[+\-±]\s?\d+\.\d{3}"
SPEC_PATTERNS = [r"(?iu)DN\d+", r"(?iu)[ΦØ]\d+", r"(?iuU)(?:YJV|BV|VV|KVV|ZR|NH)[\w\-*×/]*", r"(?iu)[ΦØ]\d+[@]\d+"]
SPEC_TAGS = ["MODEL", "SPEC", "NAME", "型号", "规格", "编号"]
NO_SPEC = "未标注"
TITLE_ZONE = {
    "no": r"[建结水暖电通施]-?\d+|^[A-Z]{1,3}-?\d{1,3}$",
    "scale": r"1\s*[:：]\s*(\d+)",
    "name": r"平面图|立面图|剖面图|详图|系统图|大样图|总平面",
    "hint": [("建施", "ARCH"), ("结施", "STR"), ("水施", "PLUMB"), ("暖施", "HVAC"), ("电施", "ELEC")],
}
TITLE_SHEET = {
    "no": r"(?i)(?:建施|结施|水施|暖施|电施|设施|装施|总图|JS|GS|SS|NS|DS|FS|ZS)[\-]?\d{1,3}",
    "scale": r"1\s*[:：]\s*\d+",
    "revision": r"(?i)(?:版次|版本|Rev\.?|Rev)[：:\s]*([A-Z0-9.]+)",
    "name": ["平面图", "立面图", "剖面图", "大样图", "详图", "节点图", "系统图", "总平面图", "流程图", "原理图", "布置图", "示意图"],
}
NOT_A_SPACE_NAME = r"平面图|立面图|剖面图|详图|系统图|大样图|总平面|图$"
CATALOG_TITLES = ["图纸目录", "图 纸 目 录", "图纸索引", "图 纸 索 引", "目  录"]
CATALOG_NO_PATTERN = r"(?i)(?:[一-龥]{2}|[A-Z]{2})[\-]?\d{1,3}"
CATALOG_NAME_KEYWORDS = ["平面图", "立面图", "剖面图", "大样", "详图", "系统图", "总平面", "说明"]
TABLE_TYPES = [
    ("门窗表", ["门窗", "门", "窗", "M0", "C1", "洞口"]),
    ("材料表", ["材料", "规格", "材质", "数量", "单位"]),
    ("设备表", ["设备", "型号", "功率", "数量"]),
    ("图纸目录", ["图号", "图名", "图纸目录", "序号"]),
]

# --- Fixed values: construction divisions -----------------------------------------------
# division, its first sub-division, items with their keywords
DIVISIONS = [
    ("地基与基础", "地基", [("混凝土基础", ["垫层", "承台", "基础梁", "独立基础", "筏板", "桩"]),
                       ("砌体基础", ["砖基础", "毛石基础"]), ("桩基", ["灌注桩", "预制桩", "CFG桩"])]),
    ("主体结构", "混凝土结构", [("混凝土结构", ["柱", "梁", "板", "墙", "楼梯", "后浇带", "施工缝"]),
                         ("砌体结构", ["砖砌体", "砌块", "填充墙"]), ("模板", ["模板", "支架"]), ("钢筋", ["钢筋", "配筋"])]),
    ("建筑装饰装修", "地面", [("门窗", ["门", "窗"]), ("地面", ["地面", "楼面", "地砖", "地板"]), ("抹灰", ["抹灰", "腻子"]),
                        ("涂饰", ["涂料", "油漆"])]),
    ("屋面", "基层与保护", [("防水", ["防水", "卷材", "涂膜"]), ("保温", ["保温", "隔热", "挤塑板"]), ("瓦面", ["瓦", "屋面瓦"])]),
    ("建筑给水排水及供暖", "室内给水系统", [("给水管道", ["给水", "冷水", "热水", "给水管"]),
                               ("排水管道", ["排水", "污水", "雨水", "排水管", "地漏"]),
                               ("卫生器具", ["洁具", "马桶", "洗手盆", "淋浴"]), ("消火栓", ["消火栓", "消防箱"]),
                               ("喷淋", ["喷淋", "喷头", "消防管"])]),
    ("通风与空调", "送风系统", [("风管", ["风管", "风道"]), ("风口", ["风口", "散流器", "百叶"]),
                         ("空调设备", ["空调", "风机", "AHU", "FCU", "新风机"]), ("水管", ["冷媒管", "冷凝水管", "空调水管"])]),
    ("建筑电气", "室外电气", [("照明", ["照明", "灯具", "灯"]), ("动力", ["配电箱", "配电柜", "电缆", "桥架"]), ("插座", ["插座", "开关"]),
                        ("防雷接地", ["防雷", "接地", "避雷", "引下线"])]),
    ("智能建筑", "智能化集成系统", [("综合布线", ["网线", "双绞线", "光纤", "信息点"]), ("安防", ["监控", "摄像机", "门禁", "报警"]),
                           ("消防报警", ["烟感", "温感", "火灾报警", "手报"])]),
    ("建筑节能", "围护系统节能", [("围护节能", ["保温", "隔热", "节能窗", "遮阳"]), ("空调节能", ["变频", "能效"]), ("电气节能", ["LED", "节能灯具"])]),
    ("电梯", "电力驱动的曳引式或强制式电梯", [("电梯", ["电梯", "扶梯", "曳引机"])]),
]
DISCIPLINE_DIVISIONS = {
    "建筑": ["建筑装饰装修", "屋面", "建筑节能"], "结构": ["地基与基础", "主体结构"], "给排水": ["建筑给水排水及供暖"],
    "消防": ["建筑给水排水及供暖", "智能建筑"], "暖通": ["通风与空调", "建筑给水排水及供暖"], "电气": ["建筑电气", "智能建筑"],
    "智能建筑": ["智能建筑"], "装饰": ["建筑装饰装修"], "电梯": ["电梯"],
}
NO_ITEM = "未明确分项"
CONFIDENCE_HIGH, CONFIDENCE_LOW = 0.8, 0.5

# --- Fixed values: materials (category, pattern, field names by group) ---------------------
MATERIALS = [
    ("混凝土", r"(C\d{2})\s*(P[468])?\s*(防水|抗渗|微膨胀|早强)?\s*(?:混凝土|砼)?", ["强度等级", "抗渗等级", "特殊类型"]),
    ("钢材", r"(Q\d{3}[A-Z]?)\s*(?:钢板|型钢|钢)?", ["牌号"]),
    ("钢材", r"((?:[ΦφΦ]|%%c)\d{1,2})\s*[@％%]\s*(\d{2,4})", ["钢筋直径", "间距"]),
    ("钢材", r"(HRB\d{3}|HPB\d{3}|HRBF\d{3})", ["钢筋牌号"]),
    ("管材", r"(DN\d{2,4})\s*(镀锌钢管|焊接钢管|无缝钢管|铸铁管|PVC管|PPR管|PE管|铜管)?", ["公称直径", "管材"]),
    ("管材", r"(De\d{2,4})\s*(PPR|PE|PVC)?", ["外径", "管材"]),
    ("管材", r"(SC\d{2,3}|JDG\d{2,3}|KBG\d{2,3})", ["电线管规格"]),
    ("电缆", r"(YJV|VV|BV|BVR|RVV|KVV|NH-YJV)\s*[-]?\s*(\d+[x×]\d+(?:\.\d+)?)?", ["型号", "规格"]),
    ("电缆", r"(\d+[x×]\d+(?:\.\d+)?)\s*(?:mm²|平方)", ["截面积"]),
    ("保温", r"(岩棉|玻璃棉|橡塑|聚氨酯|挤塑板|聚苯板|XPS|EPS)\s*(\d{2,3})?(?:mm)?", ["材料", "厚度"]),
    ("砌体", r"(加气混凝土砌块|蒸压加气块|烧结页岩砖|混凝土多孔砖|灰砂砖|轻质隔墙板)", ["材料"]),
    ("砌体", r"(MU\d{1,2}(?:\.\d)?)\s*(砖|砌块)?", ["强度等级", "材料"]),
    ("装饰", r"(瓷砖|地砖|石材|大理石|花岗岩|木地板|涂料|乳胶漆|壁纸|铝扣板|石膏板)", ["材料"]),
    ("装饰", r"(\d{3,4}[x×]\d{3,4})\s*(地砖|瓷砖|石材)", ["规格", "材料"]),
    ("其他", r"(防水卷材|SBS|APP|聚氨酯防水涂料|水泥基渗透结晶)", ["材料"]),
    ("其他", r"(防火门|防火卷帘|防火窗)\s*(甲级|乙级|丙级)?", ["材料", "防火等级"]),
    ("钢材", r"(\d+\.\d+级)?\s*(M\d{1,2})\s*([x×]\d+)?\s*(?:螺栓)?", ["性能等级", "螺栓规格", "长度"]),
    ("设备", r"(XL-?\d+|GGD\d*|PZ\d+)\s*(?:型)?\s*(?:配电箱|柜|控制箱)?", ["设备型号"]),
    ("钢材", r"(\d{2,4}x\d{2,4}(?:x\d{1,2}(?:\.\d)?)?)\s*(方管|方通|矩形管|角钢|槽钢|工字钢|H型钢)?", ["型钢规格", "型钢类型"]),
    ("砌体", r"(M\d{1,2}(?:\.\d)?)\s*(混合砂浆|水泥砂浆|砌筑砂浆)", ["强度等级", "砂浆类型"]),
    ("电缆", r"(YJV|VV|NH-YJV)\s*[-]?\s*(\d+[x×]\d+(?:\.\d+)?\+\d+[x×]\d+(?:\.\d+)?)", ["型号", "相线+地线规格"]),
]

# --- Fixed values: process rules (id, name, discipline, category, keywords, processes) -------
PROCESS_RULES = [
    ("P-ST-001", "钢筋混凝土墙", "STR", "WALL", ["剪力墙", "混凝土", "C30", "C35", "C40", "RC"],
     ["钢筋绑扎", "模板支设", "混凝土浇筑", "模板拆除", "混凝土养护"]),
    ("P-ST-002", "钢筋混凝土柱", "STR", "COLUMN", ["混凝土", "C30", "C35", "柱"],
     ["钢筋绑扎", "模板支设", "混凝土浇筑", "模板拆除", "混凝土养护"]),
    ("P-ST-003", "钢筋混凝土梁", "STR", "BEAM", ["梁", "混凝土", "KL", "LL"],
     ["梁底模板支设", "钢筋绑扎", "侧模支设", "混凝土浇筑", "模板拆除"]),
    ("P-ST-004", "楼板", "STR", "SLAB", ["板", "楼板", "混凝土"], ["模板支设", "钢筋绑扎", "水电预埋", "混凝土浇筑", "养护"]),
    ("P-ST-005", "钢结构构件", "STR", "COLUMN", ["钢", "Q235", "Q345", "H型钢"],
     ["构件加工", "除锈涂装", "运输吊装", "高强螺栓连接", "焊接", "防腐涂装"]),
    ("P-AR-001", "砌体墙", "ARCH", "WALL", ["砌块", "加气", "砖", "砌体", "蒸压"],
     ["放线", "砌筑", "构造柱浇筑", "圈梁浇筑", "墙面抹灰"]),
    ("P-AR-002", "门窗安装", "ARCH", "DOOR", ["门", "窗", "铝合金", "塑钢"],
     ["洞口预留", "洞口修整", "门窗框安装", "门窗扇安装", "密封打胶"]),
    ("P-AR-003", "窗安装", "ARCH", "WINDOW", ["窗", "铝合金", "断桥"], ["洞口预留", "窗框安装", "玻璃安装", "打胶密封"]),
    ("P-PL-001", "镀锌钢管安装", "PLUMB", "PIPE", ["镀锌", "钢管", "DN"],
     ["管道预制", "支吊架安装", "管道敷设", "螺纹连接/沟槽连接", "水压试验", "防腐保温"]),
    ("P-PL-002", "PVC排水管安装", "PLUMB", "PIPE", ["PVC", "排水", "塑料管"],
     ["管道预制", "支吊架安装", "管道敷设", "承插粘接", "灌水试验"]),
    ("P-PL-003", "阀门安装", "PLUMB", "VALVE", ["阀", "闸阀", "蝶阀", "止回阀"], ["阀门检验", "阀门安装", "法兰连接", "严密性试验"]),
    ("P-PL-004", "消火栓安装", "PLUMB", "VALVE", ["消火栓"], ["箱体安装", "管道连接", "水枪水带配置", "试压验收"]),
    ("P-EL-001", "电缆桥架安装", "ELEC", "CABLE", ["桥架", "线槽", "TRAY"],
     ["支架安装", "桥架组装", "桥架固定", "接地跨接", "盖板安装"]),
    ("P-EL-002", "电线管敷设", "ELEC", "CABLE", ["PVC管", "JDG", "SC", "穿管"], ["管路预制", "管路敷设", "管路固定", "穿引线"]),
    ("P-EL-003", "灯具安装", "ELEC", "LIGHT", ["灯", "LED", "照明"], ["灯具检验", "接线", "灯具安装", "通电试亮"]),
    ("P-EL-004", "配电箱安装", "ELEC", "PANEL", ["配电箱", "配电柜", "POWER_BOX"],
     ["基础型钢制作", "箱体安装", "进出线连接", "绝缘测试", "送电调试"]),
    ("P-EL-005", "插座开关安装", "ELEC", "SOCKET", ["插座", "开关"], ["接线盒预埋", "面板接线", "面板安装", "通电测试"]),
    ("P-HV-001", "风管制作安装", "HVAC", "DUCT", ["风管", "镀锌钢板", "DUCT"],
     ["风管制作", "法兰制作", "支吊架安装", "风管吊装", "法兰连接", "漏风量测试", "保温施工"]),
    ("P-HV-002", "空调设备安装", "HVAC", "EQUIPMENT", ["空调", "AHU", "FCU", "风机盘管", "机组"],
     ["设备开箱检验", "基础制作", "设备就位", "减振安装", "管道连接", "电气接线", "单机试运转", "系统调试"]),
]
PROCESS_SEQUENCE = {        # place of each process in the construction sequence
    "放线": 1, "洞口预留": 1, "钢筋绑扎": 2, "洞口修整": 2, "模板支设": 3, "梁底模板支设": 3, "侧模支设": 3, "门窗框安装": 3, "窗框安装": 3, "水电预埋": 4, "接线盒预埋": 4, "门窗扇安装": 4,
    "玻璃安装": 4, "混凝土浇筑": 5, "构造柱浇筑": 5, "圈梁浇筑": 5, "模板拆除": 6, "混凝土养护": 7, "养护": 7, "砌筑": 10, "墙面抹灰": 11, "阀门检验": 19, "灯具检验": 19, "设备开箱检验": 19,
    "管道预制": 20, "风管制作": 20, "法兰制作": 20, "构件加工": 20, "支吊架安装": 21, "支架安装": 21, "基础型钢制作": 21, "基础制作": 21, "管路预制": 21, "除锈涂装": 21, "管道敷设": 22,
    "风管吊装": 22, "管路敷设": 22, "桥架组装": 22, "运输吊装": 22, "设备就位": 22, "穿引线": 22, "螺纹连接/沟槽连接": 23, "承插粘接": 23, "法兰连接": 23, "高强螺栓连接": 23, "焊接": 23,
    "桥架固定": 23, "管路固定": 23, "阀门安装": 24, "灯具安装": 24, "面板安装": 24, "箱体安装": 24, "进出线连接": 24, "接线": 24, "面板接线": 24, "管道连接": 24, "减振安装": 24, "接地跨接": 24,
    "电气接线": 24, "盖板安装": 25, "水压试验": 30, "灌水试验": 30, "漏风量测试": 30, "严密性试验": 30, "绝缘测试": 30, "通电试亮": 31, "通电测试": 31, "送电调试": 31, "单机试运转": 32,
    "系统调试": 33, "防腐保温": 34, "防腐涂装": 34, "保温施工": 34, "试压验收": 35, "密封打胶": 35, "打胶密封": 35, "水枪水带配置": 35,
}
PROCESS_STAGES = [(9, "结构施工阶段"), (15, "砌筑抹灰阶段"), (29, "安装施工阶段"), (10**6, "调试验收阶段")]

# --- Fixed values: graph synonyms ----------------------------------------------------------
SYNONYMS = [
    ("灯具", ["LIGHT", "LAMP", "灯", "LED", "FLUORESCENT"]), ("灯", ["LIGHT", "LAMP", "LED"]), ("照明", ["LIGHT", "LAMP"]),
    ("插座", ["SOCKET", "插座"]), ("开关", ["SWITCH", "开关"]), ("配电箱", ["POWER_BOX", "配电箱"]),
    ("配电柜", ["POWER_BOX", "配电柜"]), ("桥架", ["CABLE", "TRAY", "桥架"]), ("电缆", ["CABLE", "电缆"]),
    ("风管", ["DUCT", "风管"]), ("风口", ["DUCT", "风口", "AIR"]), ("阀门", ["VALVE", "阀"]), ("管道", ["PIPE", "管道"]),
    ("水管", ["PIPE", "WATER", "管道"]), ("给水", ["WATER", "给水", "PIPE"]), ("排水", ["DRAIN", "排水", "PIPE"]),
    ("消火栓", ["FIRE_HYDRANT", "消火栓"]), ("喷头", ["SPRINKLER", "喷头", "喷淋"]), ("水泵", ["WATER_PUMP", "水泵", "PUMP"]),
    ("风机", ["FAN", "风机"]), ("空调", ["AHU", "FCU", "空调"]), ("门", ["DOOR", "门"]), ("窗", ["WINDOW", "窗"]),
    ("墙", ["WALL", "墙"]), ("柱", ["COLUMN", "柱"]), ("梁", ["BEAM", "梁"]), ("板", ["SLAB", "板"]),
    ("楼梯", ["STAIR", "楼梯"]), ("轴线", ["AXIS", "轴线"]), ("家具", ["FURNITURE", "家具"]), ("洁具", ["SANITARY", "洁具"]),
]

# --- Fixed values: drawing rules (id, name, category, severity, enabled, operator, parameters, message) ---
RULES = [
    ("GEO001", "零长度直线", "geometry", "warning", True, "zero_length_line", {"threshold": 1.0e-6},
     "发现 {count} 条起终点重合的 LINE，属于无效图元，建议清理"),
    ("GEO002", "零半径圆", "geometry", "warning", True, "zero_radius_circle", {"threshold": 1.0e-6},
     "发现 {count} 个半径近似为 0 的 CIRCLE，建议清理"),
    ("GEO003", "极短线段", "geometry", "info", True, "short_line", {"threshold": 0.1},
     "发现 {count} 条长度小于 {threshold} 图形单位的线段，可能是误操作残留"),
    ("GEO004", "重复实体", "geometry", "info", True, "duplicate_entity", {},
     "发现 {count} 组位置完全重合的同类实体，建议核查是否重复绘制"),
    ("LAY001", "未使用图层", "layer", "info", True, "layer_entity_count_zero", {"exclude": ["0", "Defpoints"]},
     "共 {count} 个图层无任何实体，建议清理以减小文件体积"),
    ("LAY002", "实体位于 0 图层", "layer", "info", True, "entity_on_layer", {"layer": "0"},
     "发现 {count} 个实体位于默认图层 0，建议按专业归入专用图层"),
    ("LAY003", "图层被关闭", "layer", "info", True, "layer_is_off", {"exclude": ["Defpoints"]},
     "{count} 个图层处于关闭状态，交付前建议检查是否遗漏内容"),
    ("LAY004", "图层被冻结", "layer", "info", True, "layer_is_frozen", {}, "{count} 个图层处于冻结状态，交付前建议解冻核查"),
    ("LAY005", "图层命名不规范", "layer", "info", True, "layer_name_matches",
     {"pattern": r"^(图层\d+|Layer\d+|新建图层|New Layer)$"}, "发现 {count} 个图层使用默认/无意义命名，建议按专业规范重命名"),
    ("TXT001", "文字高度过小", "text", "info", True, "text_height_lt", {"threshold": 0.5},
     "{count} 处文字高度小于 {threshold} 图形单位，可能影响打印可读性"),
    ("TXT002", "文字内容为空", "text", "warning", True, "empty_text", {}, "发现 {count} 个空文字对象，建议清理"),
    ("BLK001", "图块属性为空", "block", "warning", True, "block_attr_empty", {},
     "{count} 个带属性图块的属性值为空，可能影响设备/材料统计"),
    ("BLK002", "未使用的块定义", "block", "info", True, "unused_block_definition", {}, "发现 {count} 个已定义但从未插入的图块，建议清理"),
    ("CRS001", "专业与图层命名不匹配", "cross_discipline", "info", False, "discipline_mismatch",
     {"expected": "ELEC", "forbidden": ["给水", "排水", "风管"]},
     "图纸判定为电气专业，但发现 {count} 处给排水/暖通相关图层，请确认是否多专业综合图"),
    ("CRS002", "构件空间碰撞", "cross_discipline", "error", False, "entity_bbox_overlap",
     {"a": ["风管", "DUCT", "给水", "排水", "PIPE"], "b": ["梁", "BEAM", "柱", "COLUMN"], "tolerance": 0.0},
     "发现 {count} 处管线与结构构件包围盒重叠，可能存在碰撞，需核查标高"),
]
FIRE_RULES = [
    ("FIRE001", "消火栓箱与结构构件净距不足", "cross_discipline", "error", True, "layer_pair_distance_lt",
     {"a": ["消火栓", "消防栓", "XHS", "FIRE HYDRANT", "HYDRANT"], "b": ["柱", "梁", "COLUMN", "BEAM"], "threshold": 200},
     "发现 {count} 处消火栓箱与柱/梁距离小于 {threshold} 图形单位，请核查安装净距"),
    ("FIRE002", "喷淋管道与风管碰撞", "cross_discipline", "error", True, "entity_bbox_overlap",
     {"a": ["喷淋", "SPRINK", "消防管", "FIRE PIPE"], "b": ["风管", "DUCT", "排烟"], "tolerance": 0.0},
     "发现 {count} 处喷淋管道与风管包围盒重叠，可能存在碰撞，需核查标高与翻弯"),
    ("FIRE003", "消防专业混入其他专业图层", "cross_discipline", "info", True, "discipline_mismatch",
     {"expected": "消防", "forbidden": ["给水", "排水", "风管", "空调", "采暖"]},
     "图纸判定为消防专业，但发现 {count} 处给排水/暖通相关图层或文字，请确认是否多专业综合图"),
    ("FIRE004", "消防设备重复布置", "geometry", "warning", True, "duplicate_entity", {},
     "发现 {count} 组位置完全重合的消防设备/管线图元，建议核查是否重复布置"),
    ("FIRE005", "消防喷头零半径圆", "geometry", "info", True, "zero_radius_circle", {"threshold": 1.0e-6},
     "发现 {count} 个半径近似为 0 的圆（常见于喷头/探测器图元），建议清理"),
    ("FIRE006", "消防说明文字高度过小", "text", "info", True, "text_height_lt", {"threshold": 2.5},
     "{count} 处消防说明文字高度小于 {threshold} 图形单位，可能影响打印可读性"),
]

# --- Fixed values: project profile (id, name, required, aliases, value pattern) ---------------
PROFILE_COMMON = [
    ("project_name", "项目名称", True, ["项目名称", "工程名称", "建设项目名称", "项目名"], None),
    ("project_location", "建设地点", True, ["建设地点", "工程地点", "项目地点", "建设地址"], None),
    ("client", "建设单位", False, ["建设单位", "业主单位", "发包人", "项目法人"], None),
    ("designer", "设计单位", False, ["设计单位", "设计院", "勘察设计单位"], None),
    ("contractor", "施工单位", False, ["施工单位", "承包人", "承建单位"], None),
    ("supervisor", "监理单位", False, ["监理单位", "监理公司"], None),
    ("project_category", "工程类别", True, ["工程类别", "工程类型", "项目类别", "建设性质"], None),
    ("design_stage", "设计阶段", False, ["设计阶段", "图纸阶段"], r"(施工图设计|施工图|初步设计|方案设计|竣工图)"),
    ("drawing_version", "图纸版本", False, ["图纸版本", "版本", "版次", "修订版本"], None),
    ("construction_scale", "建设规模", True, ["建设规模", "工程规模", "总建筑面积", "建筑面积"], None),
    ("contract_amount", "合同价/概算", False, ["合同价", "合同金额", "概算", "工程造价", "投资估算"], None),
    ("duration", "工期", False, ["工期", "计划工期", "施工工期"], None),
    ("discipline_scope", "专业范围", False, [], None),
    ("basis", "编制依据", False, ["编制依据", "设计依据", "主要依据"], None),
    ("drawing_count", "图纸张数", False, [], None),
]
PROFILE_BY_DISCIPLINE = {
    "ARCH": [("arch_floor_count", "层数", ["层数", "建筑层数", "地上层数", "地下层数"]),
             ("arch_height", "建筑高度", ["建筑高度", "檐口高度", "建筑总高度"]),
             ("arch_structure_type", "结构类型", ["结构类型", "结构形式"]),
             ("arch_fire_rating", "耐火等级", ["耐火等级", "建筑耐火等级"]),
             ("arch_land_area", "用地面积", ["用地面积", "总用地面积", "规划用地面积"])],
    "STRU": [("stru_system", "结构体系", ["结构体系", "结构形式", "结构类型"]),
             ("stru_seismic", "抗震设防烈度", ["抗震设防烈度", "设防烈度", "抗震烈度"]),
             ("stru_foundation", "基础形式", ["基础形式", "基础类型", "基础方案"]),
             ("stru_concrete_grade", "混凝土强度等级", ["混凝土强度等级", "砼强度等级"]),
             ("stru_steel_grade", "钢筋牌号", ["钢筋牌号", "钢筋级别", "钢筋种类"])],
    "PLUMB": [("plumb_water_supply", "给水方式", ["给水方式", "供水方式"]),
              ("plumb_drainage", "排水体制", ["排水体制", "排水方式"]),
              ("plumb_fire", "消防系统", ["消防系统", "消火栓系统", "自动喷水灭火系统"])],
    "HVAC": [("hvac_ac", "空调形式", ["空调形式", "空调系统", "空调方式"]), ("hvac_vent", "通风方式", ["通风方式", "通风系统"]),
             ("hvac_heat", "供暖方式", ["供暖方式", "采暖方式"])],
    "ELEC": [("elec_source", "供电电源", ["供电电源", "电源引入", "供电方式"]),
             ("elec_capacity", "变配电容量", ["变配电容量", "变压器容量", "装机容量"]),
             ("elec_lightning", "防雷等级", ["防雷等级", "建筑物防雷类别", "防雷类别"])],
    "INTELL": [("intell_systems", "智能化系统", ["智能化系统", "弱电系统"]), ("intell_network", "网络与布线", ["综合布线", "网络系统"])],
    "ELEV": [("elev_count", "电梯数量", ["电梯数量", "电梯台数"]), ("elev_load", "电梯载重", ["电梯载重", "额定载重"])],
    "ENERGY": [("energy_standard", "节能标准", ["节能标准", "节能设计标准"]),
               ("energy_insulation", "保温做法", ["保温做法", "外墙保温", "屋面保温"])],
    "MUNI": [("muni_road_grade", "道路等级", ["道路等级", "公路等级"]), ("muni_road_length", "道路长度", ["道路长度", "路线长度"]),
             ("muni_drainage", "排水体制", ["排水体制", "排水方式"])],
    "LAND": [("land_green_area", "绿化面积", ["绿化面积", "绿地面积"]), ("land_plant_spec", "苗木规格", ["苗木规格", "乔木规格"]),
             ("land_density", "种植密度", ["种植密度", "栽植密度"])],
    "STEEL": [("steel_system", "钢结构形式", ["钢结构形式", "结构体系"]), ("steel_grade", "钢材牌号", ["钢材牌号", "钢材材质"]),
              ("steel_weight", "用钢量", ["用钢量", "钢材用量"])],
}
SOURCE_CONFIDENCE = {"DERIVED": 0.95, "TITLE_BLOCK": 0.9, "TEXT": 0.85, "CATALOG": 0.8, "CIO_TEXT": 0.75, "UNKNOWN": 0.5}
DEFAULT_SOURCE_CONFIDENCE = 0.5
MIN_CONFIDENCE = 0.6

# --- Fixed values: enumerations of the data contracts -------------------------------------------
QUANTITY_UNITS = ["m", "m2", "m3", "kg", "t", "个", "樘", "株", "套", "项", "处", "m²", "m³", "㎡"]
SOURCE_LEVELS = ["DIRECT", "DERIVED", "ESTIMATED", "PENDING"]
PROJECT_CODE_PATTERN = r"^(\d{9}|\d{9}B\d{3})$"
ENTITY_SOURCES = ["VECTOR", "PDF_VECTOR", "OCR", "VISION"]
LAYER_ROLES = ["MEASURABLE", "ANNOTATION", "FRAME", "AXIS", "AUXILIARY", "FILL", "UNKNOWN"]
ACCEPTANCE_STANDARDS = ["GB50300", "MUNICIPAL", "LANDSCAPE", "OTHER"]
MATERIAL_NAMES = ["钢筋", "水泥", "砂", "石", "混凝土", "砂浆", "砌体", "管材", "阀门", "管件", "电缆", "桥架", "设备",
                  "苗木", "草皮", "模板", "保温材料", "防水材料", "其他"]
MATERIAL_UNITS = ["kg", "t", "m3", "m2", "m", "个", "套", "株", "樘", "m²", "m³"]
MATERIAL_BASES = ["MIX_RATIO", "DENSITY", "THEORETICAL_WEIGHT", "COUNT", "EXPERIENCE"]
SHEET_STATUSES = ["OK", "PENDING_SCALE", "PENDING_FRAME"]
CROSS_CHECKS = ["CONSISTENT", "CONFLICT", "UNVERIFIED"]
GEOMETRY_TYPES = ["POINT", "LINE", "POLYLINE", "POLYGON", "CIRCLE", "ARC", "TEXT", "BLOCK_REF", "UNKNOWN"]
