"""Entity rows as a drawing would give them."""
from sheetmetric.model import schemas


def row(seq, dxf_type, layer, points, sheet_id=1, **kw):
    r = dict(sheet_id=sheet_id, seq=seq, entity_id=kw.pop("entity_id", f"e{sheet_id}-{seq:05d}"), dxf_type=dxf_type, layer=layer, block_name=None, label_text=None,
             points=[dict(x=float(x), y=float(y)) for x, y in points], closed=False, radius=None, start_angle=None, end_angle=None, height=None, attribs={})
    r.update(kw)
    return r


def rect(seq, layer, x, y, w, h, **kw):
    return row(seq, "LWPOLYLINE", layer, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], closed=True, **kw)


def frame(spark, rows):
    names = [c.strip().split(" ")[0] for c in schemas.ENTITY.replace("STRUCT<x: DOUBLE, y: DOUBLE>", "S").replace("MAP<STRING, STRING>", "M").split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.ENTITY)


def sheet(spark, insunits=4, discipline="ARCH", ids=(1,)):
    return spark.createDataFrame([(i, "P1", f"S{i}.dxf", insunits, 1, discipline) for i in ids], schemas.SHEET)


def quantity_drawing(sheet_id=1):
    """One plan in millimetres with a frame, walls, columns, doors, beams, a pipe, plants and tables."""
    n = iter(range(1, 1000))
    rows = [rect(next(n), "A-FRAME", 0, 0, 42000, 29700)]
    rows += [row(next(n), "TEXT", "A-FRAME", [(30000, y)], label_text=t, height=500.0) for y, t in ((1000, "建施-01"), (1500, "一层平面图"), (2000, "1:100"))]
    rows += [rect(next(n), "A-WALL", 0, 0, 8000, 5000), row(next(n), "LINE", "A-WALL", [(4000, 0), (4000, 5000)])]
    rows += [row(next(n), "INSERT", "S-COLUMN", [(x, y)], block_name="KZ1") for x in (0, 8000) for y in (0, 5000)]
    rows += [row(next(n), "INSERT", "A-DOOR", [(x, 0)], block_name=b) for b in ("M1021", "C1515") for x in (1000, 5000)]
    rows += [row(next(n), "LINE", "S-BEAM", [(0, 0), (8000, 0)]), row(next(n), "LINE", "S-BEAM", [(0, 0), (0, 5000)])]
    rows += [row(next(n), "TEXT", "S-REBAR", [(100, 100 * i)], label_text=t, height=300.0) for i, t in enumerate(("Φ12@200", "HRB400"))]
    rows += [row(next(n), "LINE", "P-PIPE", [(0, 2500), (8000, 2500)])]
    rows += [row(next(n), "INSERT", "L-PLANT", [(9000 + i, 9000)], block_name="香樟") for i in range(3)]
    rows += [row(next(n), "TEXT", layer, [(20000, 20000)], label_text="表") for layer in ("门窗表", "图例", "苗木表")]
    for r in rows:
        r["sheet_id"], r["entity_id"] = sheet_id, f"e{sheet_id}-{r['seq']:05d}"
    return rows
