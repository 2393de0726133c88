"""Template residue and error-page text (problem 10).

Lines that recur in a large share of a host's texts are its boilerplate and prove nothing beside other content. What remains of a document is searched for evidence:
slots left unfilled, filler, draft notes, failure messages, and demands for scripts or a browser check. All of it stays in the JVM.
"""

from __future__ import annotations

import re
from functools import reduce
from http import HTTPStatus
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.text import fold
from annolake.operators.skew import sliced_join
from annolake.session import stored
from annolake.sources.tables import wide

#: Share of a host's different texts from which a line is boilerplate.
SHARE = 0.05

NAME = r"[ ]?[a-z](?:[\w\-. ]{0,40}|[\w\-.]{0,120})"
# Marks of template languages around a name or, where the marks have no other use, around any short run but a key of JSON; bracketed calls to fill something in.
SLOTS = (
    r"\{\{\{?(?!\s*(?:\"[^\"]*\"|'[^']*')\s*:)[^{}]{1,120}\}\}", r"\$\{(?!\\)[^{}]{1,120}\}", rf"#\{{{NAME}\}}", r"<%(?:(?!%>).){1,120}%>", r"\{%(?:(?!%\}).){1,120}%\}", rf"<<{NAME}>>", rf"@@{NAME}@@", rf"\[\[{NAME}\]\]",
    r"(?<!\w)__[a-z][\w\-.]*[a-z0-9]__(?!\w)", r"(?<![{$#%\w\"'])\{[a-z][\w\-. ]*\}(?!\})", r"(?<![\w%])%[a-z][\w\-.]*\w%(?![\w%])", r"(?<![\w%])%[sd](?!\w)", r"(?<![\w%])%\d{1,2}\$[\d.,+\-]{0,6}[a-z@](?!\w)", r"(?<![{}$#%^\w\"'\])\\.*])\{\d{1,2}\}(?!\})", r"%\(\w+\)[sd]", r"\[%?=? ?\w+ ?%\]", r"\|\w+\|(?=\s*[,.!])",
    r"\((?:dien|nhap|chen|thay|them|bo sung|insert|fill in|your) [^()]{0,60}\)", r"<(?:chen|dien|nhap|them|insert|your|ten|mo ta)\b[^<>]{0,60}>",
    r"\[(?:chen|dien|nhap|them|insert|enter|your|fill|add|ten|dung tich|mo ta|dia chi|so dien thoai|thuong hieu|placeholder|a completer|inserer|nom|votre)\b[^\[\]]{0,60}\]",
    r"\[object object\]", r"\bundefined\b", r":\s*(?:null|nan|none|n/?a)\s*(?:₫|$|[.,;])", r"(?:chao|hello|hi|dear|bonjour) (?:null|nan|none)\b", r"\.{8,}|…{4,}|_{5,}", r"\bx{5,}\b", r"\[\[?(?:todo|tbd|tk|xxx+)\]?\]",
)
LOREM = "lorem|ipsum|dolor|dolore|dolores|sit|amet|consectetur|consectetuer|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|aliquip|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum|vestibulum|pharetra|nunc|porta|ut|et|at|in"
FILLERS = (
    rf"(?:\b(?:{LOREM})\b[ ,.]*){{5}}", r"\b([a-z]{2,12})(?:[ \-]+\1\b){4}", r"\b([a-z]+ [a-z]+)(?: \1\b){3}", r"\b(abc|xyz|aaa+|asdf|qwer|qwerty|asdfgh|blah|bla|test|demo|foo|xxx|text|lorem)(?:[ \-,]+\1\b){2}", r"\basdf(?:gh\w*)?\b.*\bqwer",
    r"(?:^|[.\"] ?)noi dung mau\b", r"\bdoan van ban mau\b", r"\bvan ban giu cho\b", r"\b(?:noi dung|van ban|chu) (?:giu cho|tam thoi|thay the)\b", r"\bdong thu nghiem \d", r"\bbai viet thu nghiem\b", r"\btieu de \d+ ?/ ?tieu de \d+", r"\bsample text\b", r"\btexte? (?:provisoire|a remplacer|d'exemple)\b", r"\bplaceholder (?:text|content)\b", r"\b(?:dummy|filler) text\b", r"\byour (?:text|content|title) (?:goes )?here\b", r"\binsert (?:\w+ ){1,3}here\b", r"\bheadline here\b",
)
DRAFTS = (
    r"(?:^|[.!\[(/#*\- ])(?:todo|fixme|tbd)\b ?[:\-(\])]", r"(?:^|\W)\((?:nhap|ban nhap|draft|brouillon)\)", r"^\W*\[?(?:ban nhap|draft|brouillon)\]?\s*[:\-]", r"\bphan nay (?:se )?viet sau\b", r"\bviet (?:them|tiep|sau) (?:o day|sau)\b", r"\bbo sung\b.{0,60}\b(?:truoc khi dang|sau khi co)\b", r"\b(?:xin |hay |can )?thay bang noi dung that\b", r"\bthay so that\b", r"\b(?:to be (?:completed|written|added|announced)|coming soon)\b", r"\bdang cap nhat noi dung\b", r"\bnoi dung dang (?:duoc )?cap nhat\b", r"\ba completer\b", r"\ba remplacer avant\b",
)
#: The standard reasons of failing requests.
REASONS = "|".join(re.sub(r"[^a-z']", ".{0,2}", x.phrase.lower()) for x in HTTPStatus if x >= 400) + "|gateway time-?out|service (?:temporarily )?unavailable|internal server"
#: How a failure message begins.
LEAD = r"(?:^|[.!?\"] )\W*(?:error|erreur|loi|ma loi|http(?: error)?|oops|rat tiec|sorry|thong bao he thong|xin loi|status|canh bao|warning|fatal error)"
FAILURES = (
    rf"{LEAD}(?: ma| code)?[ :#\-]*(?:[45]\d\d|\d{{4}})\b(?! lan| ngay| gio| phut)", r"\bhttp [45]\d\d\b", rf"{LEAD}\b[ :,\-!.]*(?:da xay ra|trang|yeu cau|may chu|he thong|noi dung|ket noi|dich vu|khong|the page|request|too many|upstream|le serveur|page)\b",
    rf"\b[45]\d\d[ :\-,.(]*(?:{REASONS})\b", r"\bbad gateway\b", r"\bgateway time-?out\b", r"\binternal server error\b", r"\bservice (?:temporarily )?unavailable\b", r"\baccess denied\b", r"\b403 forbidden\b", r"\bpage not found\b", r"\btoo many requests\b", r"\b(?:request|connection) timed out\b", r"\bupstream (?:connect error|server did not)\b",
    r"\bthe page could not be (?:loaded|found)\b", r"\bsomething went wrong on (?:our|this)\b", r"^\W*something went wrong\b", r"\byour request was blocked\b", r"\bpage introuvable\b", r"\ble serveur ne repond pas\b", r"\bcette page n'existe\b", r"\btraceback \(most recent", r"\bkeyerror:|\bnullpointerexception\b|\bstack trace:|\bat line \d+ of file\b", r"\bon line \d+\b.*|\.php on line", r"\bconnection refused\b",
    r"^\W*(?:ma loi|loi)? ?[\d: \-]*(?:khong tim thay trang|dich vu tam ngung|ket noi bi ngat|yeu cau bi tu choi)\b", r"\btrang (?:ban|nay)? ?(?:ban )?(?:tim|can|yeu cau|truy cap)\b.{0,20}\b(?:khong con|khong ton tai|da bi|bi doi)\b", r"\btrang (?:nay )?(?:di lac|khong ton tai|khong con o day)\b", r"\b(?:may chu|he thong) (?:khong phan hoi|dang ban|dang bao tri|gap su co)\b", r"\bnoi dung khong tai duoc\b", r"\bkhong the (?:tai|hien thi|ket noi)\b.{0,30}\b(?:trang|noi dung|may chu|co so du lieu)\b", r"\bket noi bi ngat giua chung\b", r"\byeu cau bi tu choi\b", r"\bdich vu tam ngung\b", r"\btrang (?:web )?dang bao tri\b", r"\bkhong ket noi duoc\b.{0,30}\b(?:co so du lieu|may chu)\b", r"\bqua nhieu yeu cau\b", r"\bban khong co quyen\b", r"\bphien (?:lam viec|dang nhap) (?:da )?het han\b", r"\bsession (?:has )?expired\b", r"\bda xay ra loi\b", r"\b(?:san pham|trang|noi dung|bai viet)\b.{0,10}\bkhong (?:con )?ton tai (?:hoac|nua)\b", r"\b(?:hoac|va) da bi (?:go|xoa)\b", r"\bdoes(?: not|n't) exist or\b", r"\bhas been removed or\b",
)
SCRIPTS = (
    r"\b(?:vui long|hay|xin|can|phai|moi ban) (?:bat|kich hoat|mo|cho phep) (?:javascript|script|cookie|js)\b", r"\bcan (?:co )?(?:javascript|js|script)\b", r"\bcan (?:chay|bat) (?:ma kich ban|script|javascript)\b", r"\bcho phep ma kich ban\b", r"\btrinh duyet\b.{0,30}\b(?:tat|chan|khong ho tro|bat)\b.{0,12}\b(?:javascript|scripts?|js)\b", r"\bkhi (?:java)?scripts? (?:bi chan|duoc cho phep|bi tat)\b", r"\bkiem tra cai dat (?:java)?script\b", r"\bnoscript\b",
    r"\b(?:please |must |need to )?(?:enable|turn on|activate|allow) (?:your )?(?:javascript|scripts?|cookies)\b", r"\brequires? (?:a browser with )?(?:javascript|scripts?|scripting)\b", r"\b(?:works?|available) (?:only )?(?:once|with|when|if) (?:javascript|scripts?)\b", r"\bonly works once\b.{0,20}script", r"\b(?:javascript|scripts?|scripting) (?:is|are) (?:disabled|required|needed|blocked|off)\b", r"\bactivez (?:le )?javascript\b", r"\bjavascript (?:est )?(?:desactive|requis|necessaire)\b", r"\bcocher? .{0,20}pas un robot\b",
    r"\bchecking your browser\b", r"\bverif(?:y|ying) (?:that )?you are (?:a )?human\b", r"\b(?:xac minh|xac nhan|chung minh)\b.{0,20}\bkhong phai (?:la )?(?:nguoi may|robot|may)\b", r"\bi'?m not a robot\b", r"\bcomplete the captcha\b", r"\bnhap (?:ma )?captcha\b",
)
#: Somebody tells of such a thing: words of a report. A short part in quotes is a mention and is left out.
TOLD = r"\b(?:nhieu khach bao|khach bao|to ky thuat|sua xong|hom truoc|hom qua|luc truoc|bua do|bua truoc|tung hoi|we saw|once,|yesterday|last week|was fixed|nous avons)\b"
QUOTED = r'"[^"]{1,60}"|“[^”]{1,60}”'
KINDS = {"slot": SLOTS, "filler": FILLERS, "draft": DRAFTS, "failure": FAILURES, "script": SCRIPTS}


def lines(text: Column) -> Column:
    """The lines and sentences of a text, folded, with single blanks and digits as they are. A choice (`a ? b : c`) in marks of a template is not cut at its question mark."""
    whole = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\S\n]+", " "), r" ?\n\s*", "\n")
    return F.filter(F.transform(F.split(fold(whole), r"\n+|(?<=[.!]) |(?<=\?) (?![^{}<>?\n]{0,80} : [^{}<>\n]{0,80}(?:\}|%>))"), F.trim), lambda x: x != "")


#: What a line must hold for a pattern of its kind to be tried at all; looked for as it is.
TRIGGERS = {
    "slot": ("{", "<", "@@", "__", "[", "%", "(dien ", "(nhap ", "(chen ", "(thay ", "(them ", "(bo sung ", "(insert ", "(fill in ", "(your ", "|", "undefined", "null", "nan", "none", "n/a", ": na", "........", "……", "xxxxx"),
    "filler": ("lorem", "ipsum", "dolor", "amet", "labor", "elit", "adipisc", "nostrud", "tempor", "consequat", "aliqu", "veniam", "fugiat", "pariatur", "ullamco", "voluptate", "cillum", "eiusmod", "incididunt", "commodo", "irure", "magna", "vestibulum", "asdf", "noi dung", "van ban", "thu nghiem", "tieu de", "sample text", "texte", "placeholder", "filler", "dummy", " here", "chu "),
    "draft": ("todo", "fixme", "tbd", "nhap", "draft", "brouillon", "viet ", "bo sung", "thay ", "to be ", "coming soon", "cap nhat", "complete", "remplacer"),
    "failure": ("error", "erreur", "loi", "http", "oops", "tiec", "sorry", "thong bao", "status", "canh bao", "warning", "gateway", "unavailable", "denied", "forbidden", "not found", "too many", "timed out", "upstream", "the page", "something went", "was blocked", "introuvable", "serveur", "n'existe", "traceback", "exception", "stack trace", "at line", "on line", ".php", "refused", "khong tim thay", "khong con", "ton tai", "bi go", "bi xoa", "removed", " exist", "da bi", "bi doi", "di lac", "phan hoi", "dang ban", "bao tri", "su co", "khong tai duoc", "khong the", "bi ngat", "bi tu choi", "tam ngung", "khong ket noi", "qua nhieu", "co quyen", "het han", "expired", "bad request", "unauthorized"),
    "script": ("script", "kich ban", "cookie", "captcha", "robot", "nguoi may", "khong phai", "browser", "human", " js"),
}
#: A word four times over is tried in any line.
REPEATED = FILLERS[1:4]


def _hits(line: Column, triggered: bool = True) -> dict[str, Column]:
    """Whether a folded line holds evidence, by kind. What is told about messages, scripts and filler is none."""
    told, hits = line.rlike(TOLD), {}
    for kind in KINDS:
        said = line if kind in ("slot", "draft") else F.regexp_replace(line, QUOTED, '""')
        hit = _any(said, KINDS[kind]) if kind == "filler" else said.rlike("|".join(f"(?:{p})" for p in KINDS[kind]))
        if triggered:
            hit = reduce(or_, (F.contains(line, F.lit(t)) for t in TRIGGERS[kind])) & hit
            if kind == "filler":
                hit = hit | _any(line, REPEATED)
        hits[kind] = hit if kind in ("slot", "draft") else hit & ~told
    return hits


def evidence(line: Column, triggered: bool = True) -> Column:
    """The first kind of evidence that a folded line holds, or null."""
    return F.coalesce(*(F.when(hit, kind) for kind, hit in _hits(line, triggered).items()))


def kinds(line: Column) -> Column:
    """All kinds of evidence that a folded line holds."""
    return F.array_compact(F.array(*(F.when(hit, kind) for kind, hit in _hits(line).items())))


def _any(line: Column, patterns: tuple[str, ...]) -> Column:
    """Patterns with groups of their own can't be joined."""
    return reduce(or_, (line.rlike(p) for p in patterns))


def residue(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """Rows (id, line, kind): lines of documents (id, text, host) that hold evidence and are not boilerplate of the host, once for each kind that they hold.

    All lines are counted by host. A line is boilerplate if it, or one that differs in numbers but for status codes, stands in `share` of the host's different texts, and in two at
    least, as else it does not recur; the size of the host has no other part in it. It is left out only of documents that hold something else too: a line that does not recur like this.
    What is nothing but an error page or a notice stays, however often it recurs. Null texts have no lines, null hosts are one host, repeated documents count
    once for recurrence and each have their rows; empty tables give no rows.

    Each different line is judged once. Hosts, lines and texts are told apart by hashes of 64 bits where they are counted.
    """
    host, text = F.coalesce("host", F.lit("")), F.coalesce("text", F.lit(""))
    held = stored(documents.select("id", F.xxhash64(host).alias("host"), F.xxhash64(text).alias("key"), lines(text).alias("lines")), "lines")
    sizes = held.groupBy("host").agg(F.countDistinct("key").alias("texts"))

    def recurring(rows: DataFrame) -> DataFrame:
        """Of rows (host, key, mark) the marks that recur in the host's texts."""
        often = rows.distinct().groupBy("host", "mark").agg(F.count("*").alias("n")).filter("n > 1")
        return sliced_join(often, sizes, ["host"], "mark").filter(F.col("n") >= share * F.col("texts")).select("host", "mark")

    each = held.select("host", "key", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("mark"))
    boilerplate = recurring(each)
    # Written before they are judged: a filter on what was judged would else be moved before distinct().
    different = stored(wide(held.select(F.explode("lines").alias("line")).distinct()), "different")
    judged = different.withColumn("kinds", kinds(F.col("line"))).filter("size(kinds) > 0")
    shape = F.xxhash64(F.regexp_replace("line", r"\b(?![45]\d\d\b)\d+", "0"))
    judged = stored(judged.select("line", F.xxhash64("line").alias("mark"), shape.alias("shape"), "kinds"), "evidence")
    # Few documents hold evidence; only their lines are looked at further.
    marks = sliced_join(held.select("id", "host", "key", F.explode("lines").alias("line")).withColumn("mark", F.xxhash64("line")), judged.select("mark", "line", "shape", "kinds"), ["mark", "line"], "id")
    proven = stored(marks.select("id", "host", "key", "line", "mark", "shape", "kinds"), "proven")
    known = boilerplate.join(proven.select("host", "mark").distinct(), ["host", "mark"], "left_semi").unionByName(recurring(proven.select("host", "key", F.col("shape").alias("mark"))))
    known = known.distinct()
    suspect = sliced_join(proven.select("host", "key", F.explode(F.array("mark", "shape")).alias("mark")), known, ["host", "mark"], "key", "left_semi").select("host", "key").distinct()
    suspect = stored(suspect, "suspect")
    other = each.join(suspect, ["host", "key"], "left_semi").join(proven.select("host", "key", "mark").distinct(), ["host", "key", "mark"], "left_anti")
    other = sliced_join(other, boilerplate, ["host", "mark"], "key", "left_anti").select("host", "key").distinct()
    beside = sliced_join(proven.select("host", "key", "mark", "shape", F.explode(F.array("mark", "shape")).alias("m")), known.withColumnRenamed("mark", "m"), ["host", "m"], "key", "left_semi").join(other, ["host", "key"], "left_semi")
    left = proven.join(beside.select("host", "key", "mark").distinct(), ["host", "key", "mark"], "left_anti")
    return left.select("id", "line", F.explode("kinds").alias("kind"))
