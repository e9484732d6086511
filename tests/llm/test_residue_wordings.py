"""Sentences outside the test tables: what is found of them, and what must not be.

All were written by the hand that wrote the lexicon. LATER holds four sets in the order in which they were written, each
before the lexicon was run on it. At that first look 21 of 28, 25 of 30, 28 of 33 and 18 of 26 were found, and 1 of 79 plain
sentences was taken for residue; then the lexicon was widened, so that what is asserted here is no longer held out."""

from collections import Counter

from rollframe.llm import residue as r

#: Written in an earlier round; the lexicon's first version found 38 of these 41.
HELD_OUT = {
    "filler": [
        "Sample text: the real article will be inserted here before publication.", "This is dummy text for the layout and will be replaced.", "Lorem ipsum dolor sit amet, sed do eiusmod tempor.",
        "Insert your content here.", "This page is still under construction, please check back soon.", "Ut enim ad minim veniam, quis nostrud exercitation ullamco.",
        "这是一段占位文字，正式内容稍后补充。", "示例文本，请替换为正式内容。", "本栏目正在建设中，敬请期待。", "这里是正文内容，请在此输入文字。",
    ],
    "error": [
        "404 Not Found. The requested page was not found on our server.", "Sorry, the page you were looking for doesn't exist.", "HTTP Error 503: the service is unavailable.", "500: the server encountered an internal error and could not complete your request.",
        "Your session has timed out, please sign in again.", "You must be logged in to view this page.", "The site is currently undergoing scheduled maintenance, please try again later.", "403 Forbidden. You don't have permission to access this page.",
        "Connection to the database could not be established.", "This site can't be reached; the connection has timed out.", "504 Gateway Time-out nginx", "Too many requests. Please slow down and try again later.",
        "抱歉，您要查看的页面不存在。", "404 页面未找到，请检查网址是否正确。", "系统正在维护中，请稍后访问。", "登录超时，请重新登录。", "您没有访问此页面的权限，请联系管理员。", "服务器开小差了，请稍后再试。", "网络异常，请检查网络后重试。", "请先登录后再查看本页内容。",
        "Lo sentimos, la página que busca no existe.", "Error interno del servidor, inténtelo más tarde.",
    ],
    "script": [
        "JavaScript is required to view this site.", "Please enable JavaScript in your browser settings to use this website.", "This application needs JavaScript to work properly.", "Your browser does not support JavaScript, or it is turned off.",
        "You have JavaScript disabled; some features will not be available.", "本页面需要启用 JavaScript 才能正常显示。", "您的浏览器未开启 JavaScript，请开启后刷新页面。", "请在浏览器设置中允许运行脚本。", "Active JavaScript en su navegador para ver esta página.",
    ],
}
#: Text that only speaks of such things, and plain text with their words.
SPOKEN = [
    "If the portal shows a page-not-found message, call the service desk.", "Last week the website was down for two hours because of maintenance; it is running again.", "The course teaches young people JavaScript and how to write scripts.",
    "The manual describes what lorem ipsum is used for in drafts.", "Residents who forget the password can sign in again with the code sent by text message.", "The gateway building stays closed for maintenance until May.",
    "Access to the archive is denied to visitors without a permit.", "系统维护期间无法办理的业务，可到窗口补办。", "上周网站因升级维护停用两小时，目前运行正常。", "如页面显示“访问被拒绝”，请拨打服务热线咨询。", "手册说明了模板中的占位文字应当如何替换。", "会议室的网络异常已由管理员修复。",
    "登录后可以查看本人的办理进度。", "申请材料不存在缺漏的，当场受理。", "La página web explica qué documentos debe traer.", "The clerk enters the content of the form and the page number.",
]
LATER = [
    "JavaScript is required to view this site.", "Click here to edit this text.", "HTTP 404 - File not found", "Insert text here.", "This content is currently unavailable.", "Oops! That link seems to be broken.", "We're having trouble loading this page. Please refresh.", "Turn JavaScript on to continue.", "Sorry, we can't show this page right now.", "Error 500 - Internal Server Error", "Connection timed out. Error code 522", "Replace this paragraph with your own content.", "Double-click to edit the title.", "网站升级中，暂停访问。", "请求的页面走丢了。", "对不起，服务器暂时没有响应，请过一会再试。", "浏览器版本过低，不支持脚本。", "本页内容正在编辑，稍后发布。", "此处插入正文。", "Esta página no está disponible.", "JavaScript está desactivado en su navegador.", "El servidor no responde, inténtelo más tarde.", "Please verify that you are not a robot.", "You are not authorized to view this resource.", "Sample paragraph. Replace with final copy before launch.", "Your login session is no longer valid. Please sign in again.", "资源不存在或无权查看。", "尊敬的用户，系统升级维护中，请稍后访问。",
    "We can't seem to find the page you're looking for.", "The link you followed may be broken, or the page may have been removed.", "Error 404: resource not found", "Our servers are busy right now. Please try again in a few minutes.", "This website is down for maintenance. We'll be back soon!", "An unexpected error occurred while processing your request.", "Your connection was reset. Reload the page.", "Login required. Please sign in to continue.", "Your session ended. Log in again.", "To use this site, enable scripts in the browser settings.", "Scripts are blocked. Please allow scripts and reload.", "Without JavaScript this page does not work.", "Heading goes here", "Type your text here", "Placeholder paragraph, replace before publication.", "服务暂不可用，请稍候重试。", "抱歉，出错了，请返回首页。", "该链接已失效。", "页面加载超时，请刷新。", "登录已过期，请重新登录。", "访问过于频繁，请稍后再试。", "请先完成人机验证。", "本站需要浏览器支持 JavaScript。", "脚本已被浏览器拦截。", "此处添加标题", "示例段落，发布前删除。", "栏目筹备中，敬请期待。", "Ha ocurrido un error. Inténtelo de nuevo más tarde.", "Página en mantenimiento.", "Texto de ejemplo, reemplazar antes de publicar.",
    "Sorry, nothing was found at this address.", "The page cannot be displayed.", "This page has expired. Please refresh.", "We encountered a problem loading this page. Try again later.", "Database error: could not connect to server.", "Proxy error: the host did not respond.", "Service is temporarily overloaded. Please come back later.", "Access forbidden. Contact the administrator.", "Please log in to see this content.", "Session timeout. Please log back in.", "Complete the captcha to proceed.", "Unhandled exception: null reference", "Your browser has JavaScript turned off.", "Please switch on JavaScript to use the site.", "This site requires cookies and JavaScript.", "Paragraph text here", "Add a title here", "Template text, to be replaced before launch.", "Dummy content for layout.", "本页面无法显示。", "您请求的资源不存在。", "服务器连接失败，请重试。", "系统故障，请联系客服。", "无权访问该资源。", "会话超时，请重新登录。", "当前访问人数过多，请稍候。", "未开启 JavaScript，无法显示内容。", "请允许脚本运行后刷新。", "标题文字写在这里", "正文内容待补充。", "Error al cargar la página.", "Acceso prohibido.", "Inserte aquí el texto.",
    "Hmm, that page isn't here any more.", "The web server reported an error.", "Please refresh the browser; the request took too long.", "This service is currently unavailable.", "We are performing scheduled maintenance and will be back soon.", "You need permission to view this page.", "Your session is invalid. Please log in.", "Confirm you are not a robot to continue.", "Scripting must be enabled in your browser.", "Enable cookies and JavaScript to continue.", "This area is under construction.", "Sample heading and sample text, please replace.", "Write your content here.", "Temporary text for the design, do not publish.", "该网站暂时无法打开。", "页面出错，请返回上一页。", "请求失败，请稍后重试。", "后台服务异常，请联系管理员。", "登录状态已失效，请重新登录。", "您的操作太频繁，请稍后再试。", "浏览器禁用了脚本，请开启。", "请打开 JavaScript 后重新加载页面。", "在此处添加文字", "占位内容，上线前替换。", "El enlace no existe o ha sido eliminado.", "Servidor ocupado, intente de nuevo.",
]
#: Plain sentences with the same words.
PLAINLY = [
    "The court said that access was denied to the applicant in May.", "The form on page 3 was not found in the file.", "Details are in the [guide](https://example.org/guide) and the [office](https://example.org/office).", "The clerk could not find the file and asked for a copy.", "The server at the canteen was busy at noon.", "If the page does not load, call the desk.", "申请材料不齐的，系统无法提交。", "请在网站上查看办理进度。", "用户登录后可以查看历史记录。", "系统繁忙时段为上午十点，建议错峰办理。", "The title of the deed must be shown.", "Children need support at home.", "Enable the alarm when you leave the building.", "数据库由市信息中心维护。", "网关设备故障已报修，预计周三恢复。", "Add the text of the law to the annex.", "会议改期，请稍后联系。", "The website explains how to replace a lost card.", "<title>Fees</title><address>Main Road 5</address>", "连接城区与郊区的公交线路暂停服务。", "服务窗口暂停服务半天。", "Error in the address must be reported within 5 days.", "请输入的内容以身份证为准。", "El servicio no está disponible los domingos por la tarde en la oficina.", "The page was removed from the file by the clerk.", "Applicants who do not have permission must apply.", "null and void",
    "The network of bus lines was extended in May.", "The host opens the hall at nine.", "Please try again to reach the clerk by phone before noon.", "Residents may view the plans at the office.", "A refused application can be appealed within a month.", "He found an error in the bill and asked for a refund.", "The gateway to the park is closed.", "The service desk is busy on Mondays.", "Open the form and write your name.", "The editor of the town paper asked for the text.", "系统将自动发送短信提醒。", "如果登录失败三次，账户将被锁定。", "窗口检查材料是否齐全。", "网络培训课程下周上线。", "The session of the council ended at six.", "Permission to cut the tree was denied.", "Page 12 of the guide lists the fees.", "La página 3 del formulario no se entrega.", "数据错误的，由受理人更正后重新提交。", "The request was completed in two days.", "维护费每月三十元。", "Scripts for the school play are kept in the library.",
    "The host family found no error in the bill.", "Please come back later if the counter is full.", "The address could not be found by the courier.", "The library page lists titles here.", "登录名由本人填写。", "超时未取的证件由窗口保管。", "服务人员联系客户后重新安排。", "The doors are closed while work is in progress.", "Title and date go on the first line.", "He types the text and sends the letter.", "El texto de la ley se publica en el boletín.", "A script for the hotline was written in June.", "该资源由市档案馆保管。", "The request failed because the fee was not paid.", "The court found the contract invalid.", "Without a permit, access to the roof is forbidden.",
    "The web of streets around the harbour is being rebuilt.", "The page boy opened the door.", "He was not found at the address on the form.", "Sign in at the front desk and take a number.", "The maintenance fee is due in June.", "The robot in the lobby answers questions.", "Text the number on the card to the hotline.", "Access roads are blocked by snow.", "网站由信息中心负责运行。", "服务大厅暂停办理，明日恢复。", "请在此处签字并注明日期。", "他的请求被拒绝后提出复议。", "El servidor público atiende en la ventanilla.", "The error rate fell by half last year.",
]
PLAIN = ["同一地址内重复提出阳台光伏备案延续的，按变更处理。", "Time spent on missing papers is not counted.", "Los vecinos deben traer el documento con fecha y firma."]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts + PLAIN * 30)), "doc_id long, text string")
    return {x.doc_id for x in r.residue(df).collect()}


def test_recall_on_other_wordings(spark):
    texts = [text for of_kind in HELD_OUT.values() for text in of_kind] + LATER
    got = found(spark, texts)
    print(*[t for i, t in enumerate(texts) if i not in got], sep="\n")
    assert len(got) >= 0.95 * len(texts)


def test_talk_about_such_things_is_no_residue(spark):
    got = found(spark, SPOKEN + PLAINLY)
    assert [t for i, t in enumerate(SPOKEN + PLAINLY) if i in got] == []


def test_other_wordings_are_in_no_list():
    phrases = {"".join(c for c in p if c.isalpha()) for words in r.LEXICON.values() for p in words.split("|")}
    assert not phrases & {"".join(c for c in t.casefold() if c.isalpha()) for t in [t for v in HELD_OUT.values() for t in v] + LATER}


def test_messages_glued_to_content(spark):
    texts = ["无法找到该网址，返回首页" + PLAIN[0], PLAIN[0] + "Your session has expired, please log in again.", "Error 500, the server did not respond" + PLAIN[0], "User: The page cannot be displayed.", "<p>请启用 JavaScript。</p>" + PLAIN[1]]
    assert found(spark, texts) == set(range(len(texts)))
