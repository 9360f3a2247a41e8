"""Terms of the scripting language and of the commands that every script has, by code."""

from __future__ import annotations


def _table(text: str, size: int) -> dict[str, str]:
    """code=name rows; codes are filled up with spaces to their size."""
    rows = (row.partition("=") for line in text.split("\n") for row in line.split("|") if row)
    return {code.ljust(size): name for code, _, name in rows}


CODES = _table("""
ID=id|me=me|no=no|pi=pi|may=May|ask=ask|day=day|kMsg=key|tab=tab|yes=yes|jul=July|jun=June|case=case|ldt=date|days=days|file=file|from=from|cobj=item
last=last|list=list|pnam=name|null=null|doub=real|rest=rest|any=some|ctxt=text|time=time|true=true|cwor=word|year=year|apr=April|mar=March|alis=alias
pcls=class|fals=false|firs=first|hour=hours|pidx=index|mnth=month|quot=quote|spac=space|week=weeks|aug=August|fri=Friday|mon=Monday|sun=Sunday
leng=length|midd=middle|nmbr=number|pare=parent|reco=record|rslt=result|ret=return|scpt=script|TEXT=string|jan=January|oct=October|tue=Tuesday
bool=boolean|desk=desktop|gavu=gave up|hand=handler|hyph=hyphens|long=integer|min=minutes|rvse=reverse|prun=running|scnd=seconds|vers=version
wkdy=weekday|dec=December|feb=February|nov=November|sat=Saturday|thu=Thursday|enum=constant|pcnt=contents|lnfd=linefeed|prop=property|cRGB=RGB color
sep=September|wed=Wednesday|cha=character|expa=expansion|frmk=framework|cpar=paragraph|obj=reference|citm=text item|psxp=POSIX path|pALL=properties
ascr=AppleScript|dstr=date string|cusr=home folder|punc=punctuation|strq=quoted form|tstr=time string|whit=white space|utxt=Unicode text
diac=diacriticals|msng=missing value|ttxt=text returned|dlib=library folder|bhit=button returned|nume=numeric strings|temp=temporary items
docs=documents folder|down=downloads folder|shdt=short date string|osax=scripting addition|asup=application support|apps=applications folder
cura=current application|capp=application|txdl=text item delimiters|rmte=application responses
""", 4)
EVENTS = _table("""
ascrcmnt=log|aevtoapp=run|sysottos=say|sysobeep=beep|miscidle=idle|corecrel=make|coremove=move|aevtodoc=open|aevtquit=quit|rdwrread=read|coresave=save
coreclos=close|corecnte=count|sysodela=delay|ascrerr=error|aevtpdoc=print|rdwrwrit=write|coredelo=delete|coredoex=exists|ascrnoop=launch
sysooffs=offset|aevtrapp=reopen|miscslct=select|rdwrgeof=get eof|earsffdr=path to|miscactv=activate|sysonfo4=info for|coreclon=duplicate
sysodsct=run script|sysostdf=choose file|sysoload=load script|sysoGMT=time to GMT|sysocton=ASCII number|rdwrclos=close access|misccurd=current date
sysostor=store script|sysostfl=choose folder|sysodisA=display alert|GURLGURL=open location|sysorand=random number|JonsgClp=the clipboard
sysodlog=display dialog|sysontoc=ASCII character|sysoexec=do shell script|rdwropen=open for access|gtqpchlt=choose from list
sysonotf=display notification|JonspClp=set the clipboard to
""", 8)
PARAMETERS = _table("""
as A=as|rtyp=as|insh=at|errt=to|refn=to|for=for|each=each|erob=from|from=from|usin=until|VOIC=using|befo=before|errn=number|btns=buttons|mesS=message
ofty=of type|RApw=password|subt=subtitle|stng=saving to|data=with data|disp=with icon|nsou=sound name|appr=with title|wrat=starting at
prmp=with prompt|cbtn=cancel button|inSL=default items|htxt=hidden answer|okbt=OK button name|dtxt=default answer|dflt=default button
ptlr=partial result|fldc=folder creation|givu=giving up after|prdt=with properties|alen=altering line endings|perm=with write permission
empL=empty selection allowed|badm=administrator privileges|wfsp=waiting until completion|mlsl=multiple selections allowed
""", 4)
PREPOSITIONS = _table("""
at=at|by=by|in=in|of=of|on=on|to=to|for=for|from=from|into=into|onto=onto|over=over|thru=thru|abou=about|abve=above|belw=below|snce=since|undr=under
arnd=around|bsid=beside|outo=out of|agst=against|bnth=beneath|btwn=between|aprt=apart from|asdf=aside from|isto=instead of
""", 4)
#: Words that a name must not be unless it stands in bars.
RESERVED = frozenset("""
as at by if in is it me my of on or to and app but div end for get its mod not put ref set the try back copy does else exit from into last onto over
prop some tell that then thru true with about above after below equal error every false fifth first front given local ninth since sixth tenth third
times until where while whose around before behind beside eighth equals fourth global middle repeat return script second against beneath between
contain seventh through timeout without contains continue ignoring property beginning reference returning application considering transaction
""".split())


def _numbered(text: str, size: int) -> dict[int, str]:
    rows = (row.partition(" ") for line in text.split("\n") for row in line.split("|") if row)
    return {int(n): code.ljust(size) for n, _, code in rows}


#: Symbols of scripts before version 1.01: numbers that stood for terms, then for events, then for constants of enumerations.
SYMBOLS = _numbered("""
90 ----|14 TEXT|52 alis|66 arg|135 ascr|9 bool|8 capp|50 citm|49 cobj|132 ctxt|13 data|88 data|12 doub|11 enum|105 erob|102 erra|103 errn|101 errs
104 errt|46 evnt|19 exmn|51 file|99 from|16 hand|91 insh|53 insl|130 keyf|92 kocl|47 kyid|131 ldt|95 leng|2 list|3 long|56 lrs|55 ls|57 nds|54 nmbr
20 obj|112 pare|10 pcls|96 pcnt|111 pi|94 pnam|115 prdp|128 prep|114 prln|129 prop|106 ptlr|6 reco|117 rest|109 ret|107 rslt|89 rtyp|116 rvse|15 scpt
5 sing|100 snam|108 spac|110 tab|97 thru|98 to|133 txdl|48 uid|4 vect
""", 4)
SYMBOL_EVENTS = _numbered("""
58 aevtoapp|127 aevtodoc|69 ascr*|67 ascr+|68 ascr-|70 ascr/|78 ascr<|79 ascr<=|74 ascr=|76 ascr>|77 ascr>=|84 ascrAND|86 ascrNOT|85 ascrOR|73 ascr^
81 ascrbgwt|80 ascrccat|134 ascrcmnt|83 ascrcont|71 ascrdiv|82 ascrends|64 ascrerr|113 ascrinit|72 ascrmod|87 ascrneg|93 ascrnoop|65 ascrpsbr|75 ascr≠
61 coreclon|62 corecnte|63 corecrel|59 coregetd|60 coresetd|125 miscbegi|126 miscendt
""", 8)
SYMBOL_CONSTANTS = {n: (row[:4], row[5:].ljust(4)) for n, row in _numbered("""
120 kfrm/ID|138 savo/ask|123 misc/cura|122 boov/fals|119 kfrm/indx|118 kfrm/name|137 savo/no|124 cons/rmte|121 boov/true|136 savo/yes
""", 9).items()}
