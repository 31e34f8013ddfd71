"""Small workbooks written with the standard library, for tests."""

from __future__ import annotations

import zipfile
from datetime import date, datetime, time
from pathlib import Path
from xml.sax.saxutils import escape

#: The headers of the two workbooks.
CRASH_HEADERS = [
    "CÓDIGO SINIESTRO", "FECHA SINIESTRO", "HORA SINIESTRO", "CLASE SINIESTRO", "CANTIDAD DE FALLECIDOS", "CANTIDAD DE LESIONADOS",
    "CANTIDAD DE VEHICULOS DAÑADOS", "DEPARTAMENTO", "PROVINCIA", "DISTRITO", "ZONA", "TIPO DE VÍA", "RED VIAL", "COD CARRETERA",
    "COORDENADAS LATITUD", "COORDENADAS  LONGITUD", "CONDICIÓN CLIMÁTICA", "ZONIFICACIÓN", "CARACTERÍSTICAS DE VÍA",
    "PERFIL LONGITUDINAL VÍA", "SUPERFICIE DE CALZADA", "¿EXISTE SEÑAL VERTICAL?", "¿EXISTE SEÑAL HORIZONTAL?",
    "CAUSA FACTOR PRINCIPAL", "CAUSA ESPECÍFICA",
]
PEOPLE_HEADERS = ["CÓDIGO SINIESTRO", "DEPARTAMENTO", "PROVINCIA", "DISTRITO", "TIPO PERSONA", "GRAVEDAD"]


def crash(code: str, **changes) -> list:
    row = [code, datetime(2024, 5, 10), "08:30", "ATROPELLO", 1, 0, 1, "LIMA", "LIMA", "ATE", "URBANA", "AVENIDA", "VECINAL", "", -12.04, -77.03,
           "DESPEJADO", "COMERCIAL", "RECTA", "PLANO", "ASFALTO", "SI", "SI", "IMPRUDENCIA", "EXCESO DE VELOCIDAD"]
    for header, value in changes.items():
        row[CRASH_HEADERS.index(header.replace("_", " "))] = value
    return row


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v, shared: list[str] | None) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, datetime):
        days = (v - datetime(1899, 12, 30)).total_seconds() / 86400
        return f'<c r="{ref}" s="1"><v>{days!r}</v></c>'
    if isinstance(v, date):
        return f'<c r="{ref}" s="1"><v>{(v - date(1899, 12, 30)).days}</v></c>'
    if isinstance(v, time):
        return f'<c r="{ref}" s="2"><v>{(v.hour * 3600 + v.minute * 60 + v.second) / 86400!r}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if shared is not None:
        if v not in shared:
            shared.append(v)
        return f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'


def write_book(path: Path, sheets: dict[str, list[list]], use_shared: bool = True, dimension: bool = True) -> Path:
    """A workbook with one list of rows a sheet; None leaves a cell out, an empty row leaves the row out."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: list[str] | None = [] if use_shared else None
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="21"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(_cell(f"{letters(c)}{r}", v, shared) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1) if row)
            dim = f'<dimension ref="A1:{letters(max([1, *map(len, rows)]))}{max(1, len(rows))}"/>' if dimension else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}>{dim}<sheetData>{body}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared) + "</sst>")
    return path


def crash_books(folder: Path, crashes: list[list], people: list[list], **how) -> Path:
    write_book(folder / "fatal_crashes_2021_2025.xlsx", {"OTRA": [["x"]], "SINIESTROS": [[], [], [], [], CRASH_HEADERS, *crashes]}, **how)
    write_book(folder / "people_fatal_crashes_2021_2025.xlsx", {"PERSONAS INVOLUCRADAS": [[], [], [], [], PEOPLE_HEADERS, *people]}, **how)
    return folder
