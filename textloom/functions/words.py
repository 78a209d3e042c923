"""Names in the languages of the wikis, and classes of templates. Sets, so that order means nothing."""

from __future__ import annotations

import html.entities
import re


def _set(text: str) -> frozenset[str]:
    return frozenset(x.strip() for x in text.split(";") if x.strip())


CATEGORY = _set("Category; Kategorie; Catégorie; Categoría; Categoria; Категория; カテゴリ; 分类; 分類; 분류; تصنيف; Kategoria; Categorie; Kategori; Kategória; Κατηγορία; Luokka")
FILE = _set("File; Image; Media; Datei; Bild; Fichier; Archivo; Imagen; Файл; Изображение; ファイル; 画像; 文件; 檔案; 파일; 그림; ملف; Immagine; Bestand; Plik; Ficheiro; Fil; Tiedosto")
REDIRECT = _set("REDIRECT; WEITERLEITUNG; REDIRECTION; REDIRECCIÓN; ПЕРЕНАПРАВЛЕНИЕ; 重定向; 転送; 넘겨주기; تحويل; RINVIA; DOORVERWIJZING; PATRZ; OMDIRIGERING; UUDELLEENOHJAUS")
NON_ARTICLE = _set("Talk; User; Template; Portal; Module; MediaWiki; Help; Draft; Wikipedia; Project; Special; Book; TimedText") | CATEGORY | FILE | _set(
    "Diskussion; Benutzer; Vorlage; Hilfe; Modul; Discussion; Utilisateur; Modèle; Aide; Portail; Usuario; Plantilla; Ayuda; Обсуждение; Участник; Шаблон; Справка; ノート; 利用者; テンプレート; ヘルプ; 讨论; 用户; 模板; 帮助; 토론; 사용자; 틀; 도움말; نقاش; مستخدم; قالب; مساعدة"
)
IMAGE_PARAMS = _set(
    "right; left; center; centre; none; thumb; thumbnail; frame; framed; enframed; frameless; border; upright; middle; top; bottom; baseline; sub; super; sup; text-top; text-bottom;"
    "mini; miniatur; gerahmt; rahmenlos; links; rechts; zentriert; ohne; vignette; droite; gauche; centré; néant; cadre; sans_cadre; miniatura; miniaturadeimagen; derecha; izquierda; centro; ninguna; marco;"
    "サムネイル; 右; 左; 中央; なし; 缩略图; 右侧; 左侧; 居中; 无; мини; справа; слева; центр; без; 섬네일; 오른쪽; 왼쪽; 가운데; 없음; تصغير; يمين; يسار; مركز; بدون"
)
SORT_WORDS = _set("DEFAULTSORT; DISPLAYTITLE; デフォルトソート; SORTIERUNG; CLEDETRI; CLÉDETRI; ORDENAR; SEITENTITEL; AFFICHERTITRE; 정렬; 默认排序")
SWITCHES = frozenset(f"__{x}__" for x in _set("TOC; NOTOC; FORCETOC; INDEX; NOINDEX; NOEDITSECTION; NEWSECTIONLINK; NONEWSECTIONLINK; NOGALLERY; HIDDENCAT; NOCONTENTCONVERT; NOTITLECONVERT; NOCC; NOTC; START; END; STATICREDIRECT; DISAMBIG; EXPECTUNUSEDCATEGORY; KEIN_INHALTSVERZEICHNIS; INHALTSVERZEICHNIS; AUCUNSOMMAIRE; SOMMAIRE; NOTDC; TDC; 目次強制; 目次非表示; 目次; БЕЗ_ОГЛАВЛЕНИЯ; 无目录; 目錄"))
BLOCK_TAGS = ("section", "abschnitt", "categorytree", "graph", "hiero", "poem", "imagemap", "noinclude", "timeline", "gallery", "div")

CITATIONS = _set(
    "citation; cite thesis; cite report; cite map; cite sign; cite video; cite episode; cite av media; cite press; cite press release; cite patent; cite newspaper; cite website; cite magazine; cite journal; cite news;"
    "cite conference; cite encyclopedia; cite book; cite web; literatur; internetquelle; article; ouvrage; lien web; cita noticia; cita pubblicazione; cita libro; cita web; cite boek; cite nieuws; книга; cytuj"
)
DROPPED = _set(
    "use mdy dates; use dmy dates; featured article; good article; short description; bquote; cquote; quotation; quote; listen; audio; visible anchor; anchor; colend; colbegin; end div col; div col end; div col;"
    "columns; col-break; col-end; col-begin; portal bar; portal; selfref; self-reference; hatnote; for more; for other; for; other people; other uses; distinguish; redirect; about; details; further; see also;"
    "main; sfnp; harvtxt; harv; harvnb; rp; r; notelist; refend; refbegin; reflist; refn; efn; sfn"
)
FLAGS = _set("country; country data; flagdeco; flag+link; noflag; fb; flagcountry; flagicon; flag; flagg; 国旗; 国旗リンク")
RUBY = _set("ルビ; rubytext; rubi; ruby annotation; ruby text; ruby-ja; ruby; ふりがな; よみがな; 読み仮名")
INTERLANGUAGE = _set("lien; link-interwiki; illm; interlanguage link multi; interlanguage link; ill-wd; ill; 仮link; 仮リンク; 不存在条目链接")
SCRIPTS = _set("unicode; polytonic; greek; el; russian; ru; hebrew; he; arab; ar; ko-hhrm; ko; zh-cn; zh-tw; zh; ltr-lang; rtl-lang; script; ipac-ja; ipac-en; ipa; lang; translit; transliteration; transl; nihongo foot; nihongo3; nihongo2; nihongo")
CONVERTERS = _set("変換; 単位変換; cvt; convert")
FORMATTING = _set("highlight; colour; color; fontsize; font; resize; tooltip; abbr; sup2; sub2; sup; sub; fraction; frac; strong; em; thin space; thinsp; indent; space; spaces; nobr; nowrap; nbsp; big; larger; large; smaller; small")
AUTHORITY = _set(
    "commons category; commonscat; wikidata link; wikidata; worldcat; orcid; isni; sudoc; ndl; nla; bnf; gnd; lccn; viaf; coord missing; coord; speciesbox; taxonbar; persondata; normdaten; authority control; defaultsort"
)
REMNANTS = _set("commons cat; reflist; notelist-ua; notelist; right; left; center; break; br; clr; clearright; clearleft; clear")
PROJECTS = _set("school; wikifunctions; oldwikisource; species; mediawikiwiki; mediawiki; meta; commons; wikidata; wikispecies; wikivoyage; wiktionary; wikinews; wikiquote; wikisource; wikiversity; wikibooks")

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

#: Named entities with their semicolon, and three that only wikis use.
ENTITIES = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")} | {"ratio": "∶", "dash": "–", "nbso": " "}

LANGUAGES = {
    code: name
    for name, code in (
        pair.split("=")
        for pair in (
            "Zulu=zu|Chinese=zh|Zhuang=za|Yoruba=yo|Yiddish=yi|Xhosa=xh|Wolof=wo|Walloon=wa|Volapük=vo|Vietnamese=vi|Venda=ve|Uzbek=uz|Urdu=ur|Ukrainian=uk|Uyghur=ug|Twi=tw|Tatar=tt|Tsonga=ts|Turkish=tr"
            "|Tongan=to|Tswana=tn|Tagalog=tl|Turkmen=tk|Tigrinya=ti|Thai=th|Tajik=tg|Telugu=te|Tamil=ta|Swahili=sw|Swedish=sv|Sundanese=su|Southern Sotho=st|Swati=ss|Serbian=sr|Albanian=sq|Somali=so|Shona=sn"
            "|Samoan=sm|Slovenian=sl|Slovak=sk|Sinhala=si|Northern Sami=se|Sindhi=sd|Sardinian=sc|Sanskrit=sa|Kinyarwanda=rw|Russian=ru|Romanian=ro|Romansh=rm|Quechua=qu|Portuguese=pt|Pashto=ps|Polish=pl"
            "|Punjabi=pa|Oriya=or|Occitan=oc|Norwegian=no|Dutch=nl|Nepali=ne|Burmese=my|Maltese=mt|Malay=ms|Marathi=mr|Mongolian=mn|Malayalam=ml|Macedonian=mk|Maori=mi|Malagasy=mg|Latvian=lv|Lithuanian=lt|Lao=lo"
            "|Luxembourgish=lb|Latin=la|Kyrgyz=ky|Kurdish=ku|Korean=ko|Kannada=kn|Khmer=km|Kazakh=kk|Georgian=ka|Javanese=jv|Japanese=ja|Italian=it|Icelandic=is|Indonesian=id|Armenian=hy|Hungarian=hu|Croatian=hr"
            "|Hindi=hi|Hebrew=he|Hausa=ha|Gujarati=gu|Guarani=gn|Galician=gl|Scottish Gaelic=gd|Irish=ga|Frisian=fy|French=fr|Faroese=fo|Fijian=fj|Finnish=fi|Persian=fa|Basque=eu|Estonian=et|Spanish=es|Esperanto=eo"
            "|English=en|Greek=el|Dzongkha=dz|Divehi=dv|German=de|Danish=da|Welsh=cy|Czech=cs|Catalan=ca|Breton=br|Tibetan=bo|Bengali=bn|Bulgarian=bg|Belarusian=be|Bashkir=ba|Azerbaijani=az|Assamese=as|Arabic=ar"
            "|Amharic=am|Afrikaans=af|Abkhazian=ab|Afar=aa|Classical Syriac=syc|Old Irish=sga|Old Persian=peo|Old Norse=non|Middle High German=gmh|Old French=fro|Old English=ang|Ancient Greek=grc"
        ).split("|")
    )
}

#: Of one unit in another, as printed by the wikis' converters.
FACTORS = {
    tuple(k.split(">")): v
    for k, v in {
        "floz>ml": 29.5735, "ml>floz": 0.033814, "gal>l": 3.78541, "l>gal": 0.264172, "km/h>m/s": 0.277778, "m/s>km/h": 3.6, "mph>km/h": 1.60934, "km/h>mph": 0.621371,
        "sqft>m2": 0.092903, "m2>sqft": 10.7639, "acre>ha": 0.404686, "ha>acre": 2.47105, "sqmi>km2": 2.58999, "km2>sqmi": 0.386102, "lb>t": 0.000453592, "t>lb": 2204.62,
        "oz>g": 28.3495, "g>oz": 0.035274, "lb>kg": 0.453592, "kg>lb": 2.20462, "m>yd": 1.09361, "yd>m": 0.9144, "in>mm": 25.4, "mm>in": 0.0393701, "in>cm": 2.54, "cm>in": 0.393701,
        "ft>m": 0.3048, "m>ft": 3.28084, "mi>km": 1.60934, "km>mi": 0.621371,
    }.items()
}
SYMBOLS = {"floz": "fl oz", "ml": "mL", "l": "L", "sqft": "sq ft", "m2": "m²", "acre": "acres", "sqmi": "sq mi", "km2": "km²", "F": "°F", "C": "°C"}

#: Section names that mean the same; the first is the usual one.
SECTION_GROUPS = {
    x.split(":")[0]: x.split(":")[1].split("/")
    for x in (
        "Discography:Discography and videography", "Filmography:Films", "Career:Professional career", "Early life:Early years/Childhood/Early life and education", "Legacy:Cultural legacy/Cultural impact/Influence/Impact",
        "Awards:Accolades/Honors/Awards and nominations", "Bibliography:Selected bibliography/Selected works/Publications/Works", "See also:Related pages/Related articles", "External links:External sources",
        "References:Notes and references/Citations/Footnotes/Notes", "Reception:Critical response/Reviews/Critical reception", "Plot:Story/Plot summary/Synopsis",
    )
}


def any_of(names) -> str:
    """An alternation of literal names, longest first."""
    return "|".join(re.escape(x) for x in sorted(names, key=lambda x: (-len(x), x)))
