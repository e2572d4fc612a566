"""Field extraction from stored pages.

Spark splits and ships the pages; a small helper walks one page's elements with the
standard HTML parser and returns the fields that page holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SIBLING_LABELS = {
    "so_dang_ky": ["Số đăng ký", "SĐK", "Reg.No", "Sđk"],
    "dang_bao_che": ["Dạng bào chế", "Bào chế", "Dạng chế phẩm"],
    "quy_cach_dong_goi": ["Quy cách đóng gói", "Đóng gói", "Quy cách"],
    "cong_ty_sx": ["Công ty sản xuất", "Nhà sản xuất", "Cơ sở sản xuất", "Sản xuất bởi"],
    "nuoc_sx": ["Nước sản xuất", "Xuất xứ"],
    "cong_ty_dk": ["Công ty đăng ký", "Đơn vị đăng ký", "Cơ sở đăng ký"],
    "nhom_thuoc": ["Nhóm thuốc", "Danh mục", "Loại thuốc"],
    "ham_luong": ["Hàm lượng", "Nồng độ", "Thành phần hàm lượng"],
}
SECTION_LABELS = {
    "chi_dinh": ["Chỉ định", "Chỉ định điều trị", "Công dụng", "Chỉ định và công dụng"],
    "chong_chi_dinh": ["Chống chỉ định", "Chống chỉ định và thận trọng"],
    "lieu_dung": ["Liều dùng", "Cách dùng", "Hướng dẫn sử dụng", "Liều dùng và cách dùng"],
    "tac_dung_phu": ["Tác dụng phụ", "Tác dụng không mong muốn", "Phản ứng có hại"],
    "than_trong": ["Thận trọng", "Lưu ý", "Cảnh báo và thận trọng"],
}
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT_TAGS = frozenset(("script", "style", "template"))
VALUE_TAGS = frozenset(("div", "p", "span", "td"))
# ----------------------------------------------------------------------------
FIELDS = ["ten_thuoc", "hoat_chat", *SIBLING_LABELS, *SECTION_LABELS]
_SELF_CLOSING = frozenset(("p", "li", "tr", "td", "th", "dt", "dd"))


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def text(self) -> str:
        parts: list[str] = []
        stack: list = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item.tag not in SILENT_TAGS:
                stack.extend(reversed(item.children))
        return " ".join("".join(parts).split())

    def following(self) -> list[_Node]:
        if self.parent is None:
            return []
        siblings = self.parent.children
        at = next(i for i, c in enumerate(siblings) if c is self)
        return [c for c in siblings[at + 1:] if isinstance(c, _Node)]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _SELF_CLOSING and self.here.tag == tag:
            self.here = self.here.parent
        node = _Node(tag, dict(attrs), self.here)
        self.here.children.append(node)
        if tag not in VOID_TAGS:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(_Node(tag, dict(attrs), self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def _own_text(node: _Node) -> str:
    return next((c for c in node.children if isinstance(c, str)), "")


def _sibling(nodes: list[_Node], label: str) -> str:
    for node in nodes:
        if node.tag in VALUE_TAGS and label in _own_text(node):
            for nxt in node.following():
                if nxt.tag in VALUE_TAGS:
                    return nxt.text().lstrip(":").strip()
    return ""


def _section(nodes: list[_Node], label: str) -> str:
    for tag in ("h2", "h3"):
        for node in nodes:
            if node.tag == tag and label in node.text():
                texts = []
                for nxt in node.following():
                    if nxt.tag in ("h2", "h3"):
                        break
                    texts.append(nxt.text())
                return "\n".join(t for t in texts if t)
    return ""


def _has_class(node: _Node, name: str) -> bool:
    return name in (node.attrs.get("class") or "").split()


def page_fields(html: str, extra: dict[str, list[str]] | None = None) -> tuple[dict[str, str], list[tuple[str, str]], str]:
    """Fields, (name, dose) rows of the ingredient table, and the main text of one page.

    `extra` gives fallback selectors per field (`tag`, `.class` or `#id`) for fields the
    labels did not supply. The first hit per field wins.
    """
    tree = _Tree()
    tree.feed(html or "")
    nodes = list(tree.root.walk())
    out: dict[str, str] = {}
    heading = next((n.text() for n in nodes if n.tag == "h1"), "")
    if heading:
        out["ten_thuoc"] = heading
    for n in nodes:
        if _has_class(n, "ingredient-content"):
            out["hoat_chat"] = n.text()
            break
    for source, find in ((SIBLING_LABELS, _sibling), (SECTION_LABELS, _section)):
        for field, labels in source.items():
            value = next((v for v in (find(nodes, label) for label in labels) if v), "")
            if value and not out.get(field):
                out[field] = value
    for field, selectors in (extra or {}).items():
        for sel in selectors:
            if out.get(field):
                break
            test = (lambda n: n.attrs.get("id") == sel[1:]) if sel.startswith("#") else (
                lambda n: _has_class(n, sel[1:])) if sel.startswith(".") else (lambda n: n.tag == sel)
            out[field] = next((n.text() for n in nodes if test(n)), "")
    rows = []
    for table in (n for n in nodes if n.attrs.get("id") == "thanh-phan-hoat-chat"):
        for tr in (n for n in table.walk() if n.tag == "tr"):
            cells = [c.text() for c in tr.children if isinstance(c, _Node) and c.tag == "td"]
            if len(cells) >= 2:
                rows.append((cells[0], cells[1]))
    main = next((n for n in nodes if n.tag in ("main", "article") or n.attrs.get("id") == "content" or _has_class(n, "content")), tree.root)
    return {k: v for k, v in out.items() if v}, rows, main.text()


def extract_pages(pages: DataFrame, key: str = "page_id", html: str = "html", extra: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per page: key, the fields, `ingredients` array<struct<name,dose>> and `content`."""
    key_type = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [page_fields(h, extra) for h in batch[html]]
            out = pd.DataFrame({key: batch[key].to_numpy()})
            for f in FIELDS:
                out[f] = [x[0].get(f) for x in found]
            out["ingredients"] = [[{"name": n, "dose": d} for n, d in x[1]] for x in found]
            out["content"] = [x[2] for x in found]
            yield out

    fields = ", ".join(f"{f} string" for f in FIELDS)
    schema = f"{key} {key_type}, {fields}, ingredients array<struct<name:string,dose:string>>, content string"
    return pages.select(key, html).mapInPandas(run, schema)


def ingredient_rows(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    return extracted.select(key, F.posexplode("ingredients").alias("pos", "i")).select(key, "pos", "i.name", "i.dose")
