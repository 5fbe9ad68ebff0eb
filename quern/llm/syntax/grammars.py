"""Grammars of the languages, from their public specifications.

They are a little wider than the languages where a rule isn't about form
(operator precedence, assignable left sides, repeated modifiers).
"""

from __future__ import annotations

_JS_WORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"
).split()

#: One chain of expressions per left edge: any (''), no object first (A), no object, function or class first (N).
_JS_CHAIN = """
Assign@ = Cond@ | Arrow | Unary@ AssignOp Assign | 'yield' | 'yield' Assign | 'yield' '*' Assign ;
Cond@ = Bin@ | Bin@ '?' Assign ':' Assign ;
Bin@ = Unary@ | Bin@ BinOp Unary | PRIVATE 'in' Unary {AS@} ;
Unary@ = Prefix Unary | Postfix@ {CAST} ;
Postfix@ = Member@ | Member@ '++' | Member@ '--' ;
Member@ = Primary@ | Member@ '.' Prop | Member@ '?.' Prop | Member@ '?.' '[' Expr ']' | Member@ '?.' Args | Member@ '[' Expr ']' | Member@ Args | Member@ Template {MORE@} ;
Expr@ = Assign@ | Expr@ ',' Assign ;
"""
_JS = """
Program = Item* ;
Item = Stmt | ImportDecl | ExportDecl ;
End = ';' | ASI ;
Stmt = Block | 'var' Decls End | Lexical End | ';' | ExprN End | If | Loop | 'continue' Ident? End | 'break' Ident? End | 'return' Expr? End
  | 'with' '(' Expr ')' Stmt | Switch | Ident ':' Stmt | 'throw' Expr End | Try | 'debugger' End | Function | Class {STMT} ;
Block = '{' Stmt* '}' ;
Lexical = ('let' | 'const') Decls ;
Decls = Decl % ',' ;
Decl = Target {BANG} {ANN} ('=' Assign)? ;
If = 'if' '(' Expr ')' Stmt | 'if' '(' Expr ')' Stmt 'else' Stmt ;
Loop = 'do' Stmt 'while' '(' Expr ')' ';'? | 'do' Stmt 'while' '(' Expr ')' ASI | 'while' '(' Expr ')' Stmt
  | 'for' '(' ForInit? ';' Expr? ';' Expr? ')' Stmt | 'for' 'await'? '(' ForHead ('in' Expr | 'of' Assign) ')' Stmt ;
ForInit = Expr | 'var' Decls | Lexical ;
ForHead = Unary | ('var' | 'let' | 'const') Target {ANN} ;
Switch = 'switch' '(' Expr ')' '{' Case* '}' ;
Case = 'case' Expr ':' Stmt* | 'default' ':' Stmt* ;
Try = 'try' Block Catch | 'try' Block 'finally' Block | 'try' Block Catch 'finally' Block ;
Catch = 'catch' Block | 'catch' '(' Target {ANN} ')' Block ;
Function = 'async'? 'function' '*'? Ident {TPARAMS} Params {RET} Block {FUNSIG} ;
FunctionX = 'async'? 'function' '*'? Ident? {TPARAMS} Params {RET} Block ;
Class = {DECOS} {ABSTRACT} 'class' Ident {TPARAMS} Heritage '{' Element* '}' ;
ClassX = 'class' Ident? {TPARAMS} Heritage '{' Element* '}' ;
Heritage = ('extends' Member {TARGS})? {IMPL} ;
Element = ';' | {DECOS} {MODS} Method | {DECOS} {MODS} PropKey {OPTBANG} {ANN} ('=' Assign)? End | 'static' Block {ELEMENT} ;
Method = 'async'? '*'? PropKey {OPT} {TPARAMS} Params {RET} Body | ('get' | 'set') PropKey Params {RET} Body ;
Body = Block {NOBODY} ;
PropKey = Prop | STR | NUM | '[' Assign ']' ;
Prop = Ident | PRIVATE | Word ;
Params = '(' ')' | '(' Param % ',' ','? ')' ;
Param = {DECOS} {PMODS} Target {OPT} {ANN} ('=' Assign)? | '...' Target {ANN} {THIS} ;
Target = Ident | '{' '}' | '{' TargetProp % ',' ','? '}' | '[' TargetItem % ',' ']' ;
TargetProp = Ident ('=' Assign)? | PropKey ':' Target ('=' Assign)? | '...' Target ;
TargetItem = (Target ('=' Assign)?)? | '...' Target ;
Arrow = ArrowHead '=>' ArrowBody ;
ArrowHead = Ident | {TPARAMS} Params {RET} | 'async' Ident | 'async' {TPARAMS} Params {RET} ;
ArrowBody = Block | AssignA ;
Prefix = 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await' | '++' | '--' | '++nl' | '--nl' ;
AssignOp = '=' | '*=' | '/=' | '%=' | '+=' | '-=' | '<<=' | {SHIFTASSIGN} | '&=' | '^=' | '|=' | '**=' | '&&=' | '||=' | '??=' ;
BinOp = '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | {SHIFT} | 'instanceof' | 'in' | '<<' | '+' | '-' | '*' | '/' | '%' | '**' ;
Args = '(' ')' | '(' Arg % ',' ','? ')' ;
Arg = '...'? Assign ;
Primary = PrimaryA | Object ;
PrimaryA = PrimaryN | FunctionX | ClassX ;
PrimaryN = Ident | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | Template | '[' Elem % ',' ']' | '(' Expr ')' | 'new' Member | 'new' '.' Ident | 'import' Args | 'import' '.' Ident ;
Elem = Arg? ;
Template = TPL | TPLHEAD Expr (TPLMID Expr)* TPLTAIL ;
Object = '{' '}' | '{' Pair % ',' ','? '}' ;
Pair = Ident ('=' Assign)? | PropKey ':' Assign | Method | '...' Assign ;
ImportDecl = 'import' STR With? End | 'import' {TYPEONLY} Clause 'from' STR With? End {IMPORTEQ} ;
With = 'with' Object ;
Clause = Ident | '*' 'as' Ident | Named | Ident ',' Named | Ident ',' '*' 'as' Ident ;
Named = '{' '}' | '{' Spec % ',' ','? '}' ;
Spec = {TYPEONLY} Name ('as' Name)? ;
Name = Ident | Word | STR ;
ExportDecl = 'export' {TYPEONLY} Named ('from' STR With?)? End | 'export' {TYPEONLY} '*' ('as' Name)? 'from' STR With? End
  | 'export' 'default' (Function | Class | AssignN End | FunctionX | ClassX) | {DECOS} 'export' ('var' Decls End | Lexical End | Function | Class {STMT}) {EXPORT} ;
"""

_TS_TYPES = """
Ann = ':' Type ;
Type = UnionT | UnionT 'extends' UnionT '?' Type ':' Type | TParams? Params '=>' Ret | 'abstract'? 'new' TParams? Params '=>' Type ;
Ret = Type | 'asserts'? (Ident | 'this') 'is' Type | 'asserts' (Ident | 'this') ;
UnionT = InterT | '|' InterT | UnionT '|' InterT ;
InterT = OpT | '&' OpT | InterT '&' OpT ;
OpT = PostT | ('keyof' | 'readonly' | 'unique') OpT | 'infer' Ident ('extends' OpT)? ;
PostT = PrimT | PostT '[' ']' | PostT '[' Type ']' ;
PrimT = QName TArgs? | 'this' | 'void' | 'null' | 'true' | 'false' | 'const' | STR | NUM | '-' NUM | TemplateT | ObjectT | '[' ']' | '[' TupleItem % ',' ','? ']'
  | '(' Type ')' | 'typeof' QName TArgs? | 'typeof' ImportT | ImportT ;
ImportT = 'import' '(' STR ')' ('.' Ident)* TArgs? ;
QName = Ident | QName '.' Prop ;
TArgs = '<' Type % ',' ','? '>' ;
TParams = '<' TParam % ',' ','? '>' ;
TParam = ('const' | 'in')? Ident ('extends' Type)? ('=' Type)? ;
TemplateT = TPL | TPLHEAD Type (TPLMID Type)* TPLTAIL ;
TupleItem = Type '?'? | '...' Type | Ident '?'? ':' Type | '...' Ident ':' Type ;
ObjectT = '{' '}' | '{' MemberT (Sep MemberT)* Sep? '}' | '{' Mapped '}' ;
Sep = ';' | ',' | ASI ;
MemberT = 'readonly'? PropKey '?'? Ann? | PropKey '?'? TParams? Params (':' Ret)? | TParams? Params (':' Ret)? | 'new' TParams? Params Ann? | 'readonly'? '[' Ident ':' Type ']' Ann | ('get' | 'set') PropKey Params Ann? ;
Mapped = (('+' | '-')? 'readonly')? '[' Ident 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? Ann? (';' | ASI)? ;
TypeDecl = 'interface' Ident TParams? ('extends' TypeRef % ',')? ObjectT | 'type' Ident TParams? '=' Type End | 'const'? 'enum' Ident '{' '}' | 'const'? 'enum' Ident '{' EnumItem % ',' ','? '}'
  | ('namespace' | 'module') QName '{' Item* '}' | 'module' STR '{' Item* '}' | 'global' '{' Item* '}' | 'declare' Ambient ;
Ambient = TypeDecl | 'var' Decls End | Lexical End | Function | Class | 'module' STR End ;
TypeRef = QName TArgs? ;
EnumItem = PropKey ('=' Assign)? ;
Mod = 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'override' | 'readonly' | 'declare' | 'accessor' ;
Mods = Mod | Mods Mod ;
Deco = '@' Member ;
Decos = Deco | Decos Deco ;
"""

_HOOKS_JS = {
    "AS": "", "CAST": "", "MORE": "", "STMT": "", "BANG": "", "ANN": "", "TPARAMS": "", "RET": "", "FUNSIG": "", "DECOS": "", "ABSTRACT": "", "TARGS": "", "IMPL": "", "MODS": "'static'?", "OPTBANG": "", "ELEMENT": "", "OPT": "",
    "NOBODY": "", "PMODS": "", "THIS": "", "SHIFTASSIGN": "'>>=' | '>>>='", "SHIFT": "'>=' | '>>' | '>>>'", "TYPEONLY": "", "IMPORTEQ": "", "EXPORT": "",
}
_HOOKS_TS = {
    "AS": "| Bin@ 'as' Type | Bin@ 'satisfies' Type", "CAST": "| '<' Type '>' Unary", "MORE": "| Member@ '!' | Member@ TArgs Args | Member@ TArgs Template | Member@ TArgs", "STMT": "| TypeDecl", "BANG": "'!'?", "ANN": "Ann?", "TPARAMS": "TParams?", "RET": "(':' Ret)?",
    "FUNSIG": "| 'async'? 'function' '*'? Ident TParams? Params (':' Ret)? End", "DECOS": "Decos?", "ABSTRACT": "'abstract'?", "TARGS": "", "IMPL": "('implements' TypeRef % ',')?", "MODS": "Mods?", "OPTBANG": "('?' | '!')?",
    "ELEMENT": "| Mods? '[' Ident ':' Type ']' Ann End", "OPT": "'?'?", "NOBODY": "| End", "PMODS": "Mods?", "THIS": "| 'this' Ann", "SHIFTASSIGN": "'>' '=' | '>' '>' '=' | '>' '>' '>' '='", "SHIFT": "'>' '=' | '>' '>' | '>' '>' '>'",
    "TYPEONLY": "'type'?", "IMPORTEQ": "| 'import' 'type'? Ident '=' QName End | 'import' 'type'? Ident '=' Ident '(' STR ')' End", "EXPORT": "| 'export' '=' Assign End | 'export' 'as' 'namespace' Ident End",
}


def _script(hooks: dict[str, str], soft: str, extra: str) -> str:
    chain = "".join(_JS_CHAIN.replace("{AS@}", hooks["AS"]).replace("{MORE@}", hooks["MORE"]).replace("@", edge) for edge in ("", "A", "N"))
    text = chain + _JS + extra
    for name, body in hooks.items():
        text = text.replace("{" + name + "}", body)
    words = " | ".join(f"'{w}'" for w in _JS_WORDS)
    ident = " | ".join(["NAME", *(f"'{w}'" for w in soft.split())])
    return text + f"Word = {words} ;\nIdent = {ident} ;\n"


JAVASCRIPT = _script(_HOOKS_JS, "async await of get set static let yield from as", "")
TYPESCRIPT = _script(
    _HOOKS_TS,
    "async await of get set static let yield from as type interface namespace module declare abstract readonly keyof infer is asserts satisfies public private protected override unique implements global accessor out",
    _TS_TYPES,
)

PYTHON = """
File = Stmt* ;
Stmt = Simple | 'if' Named ':' Block Elifs? Else? | 'while' Named ':' Block Else? | 'async'? 'for' Targets 'in' Stars ':' Block Else? | Try | 'async'? 'with' Items ':' Block
  | Decorator* 'async'? 'def' Name TParams? '(' Params? ')' ('->' Stars)? ':' Block | Decorator* 'class' Name TParams? ('(' Args? ')')? ':' Block | 'match' Stars ':' NEWLINE INDENT CaseBlock+ DEDENT ;
Elifs = 'elif' Named ':' Block | Elifs 'elif' Named ':' Block ;
Else = 'else' ':' Block ;
Try = 'try' ':' Block Except+ Else? ('finally' ':' Block)? | 'try' ':' Block 'finally' ':' Block ;
Except = 'except' ':' Block | 'except' '*'? Test ('as' Name)? ':' Block | 'except' '*'? Test ',' Test % ',' ':' Block ;
Items = Item % ',' | '(' Item % ',' ','? ')' ;
Item = Test ('as' Target)? ;
CaseBlock = 'case' Pattern % ',' ','? ('if' Named)? ':' Block ;
Pattern = '*'? Test ('as' Name)? ;
Decorator = '@' Named NEWLINE ;
Block = Simple | NEWLINE INDENT Stmt+ DEDENT ;
Simple = Small % ';' ';'? NEWLINE ;
Small = Stars | Stars AugOp Value | Stars Equals | Stars ':' Test ('=' Value)? | Yield | 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Test ('from' Test)?)?
  | ('global' | 'nonlocal') Name % ',' | 'del' Targets | 'assert' Test (',' Test)? | 'import' Dotted % ',' | 'from' From 'import' Names | 'type' Name TParams? '=' Test ;
Equals = '=' Value | Equals '=' Value ;
Value = Stars | Yield ;
Yield = 'yield' Stars? | 'yield' 'from' Test ;
Dotted = Path ('as' Name)? ;
Path = Name | Path '.' Name ;
From = Path | Dots Path? ;
Dots = Dot | Dots Dot ;
Dot = '.' | '...' ;
Names = '*' | NameAs % ',' | '(' NameAs % ',' ','? ')' ;
NameAs = Name ('as' Name)? ;
TParams = '[' TParam % ',' ','? ']' ;
TParam = ('*' | '**')? Name (':' Test)? ('=' Test)? ;
Params = Param % ',' ','? ;
Param = Name (':' Test)? ('=' Test)? | '*' | '*' Name (':' '*'? Test)? | '**' Name (':' Test)? | '/' ;
LParams = LParam % ',' ','? ;
LParam = Name ('=' Test)? | '*' Name? | '**' Name | '/' ;
Stars = Star % ',' ','? ;
Star = Named | '*' Bin ;
Named = Test | Name ':=' Test ;
Targets = Target % ',' ','? ;
Target = '*'? Primary ;
Test = Bin | Bin 'if' Bin 'else' Test | 'lambda' LParams? ':' Test ;
Bin = Unary | Bin BinOp Unary ;
Unary = Primary | ('-' | '+' | '~' | 'not' | 'await') Unary ;
BinOp = 'or' | 'and' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
Primary = Atom | Primary '.' Name | Primary '(' Args? ')' | Primary '[' Slices ']' ;
Args = Arg % ',' ','? | Named Comp ;
Arg = Named | Name '=' Test | '*' Test | '**' Test ;
Slices = Slice % ',' ','? ;
Slice = Star | Test? ':' Test? | Test? ':' Test? ':' Test? ;
Atom = Name | NUM | Strings | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' Stars ')' | '(' Yield ')' | '(' Named Comp ')' | '[' ']' | '[' Stars ']' | '[' Named Comp ']'
  | '{' '}' | '{' Stars '}' | '{' Named Comp '}' | '{' Entry % ',' ','? '}' | '{' Test ':' Test Comp '}' ;
Entry = Test ':' Test | '**' Bin ;
Comp = For+ ;
For = 'async'? 'for' Targets 'in' Bin If* ;
If = 'if' Bin | 'if' Name ':=' Bin ;
Strings = STR | Strings STR ;
Name = NAME | 'match' | 'case' | 'type' ;
"""

GO = """
File = 'package' NAME ';' (Import ';')* (Top ';')* ;
Import = 'import' Spec | 'import' '(' Specs? ')' ;
Specs = Spec % ';' ';'? ;
Spec = ('.' | NAME)? STR ;
Top = Decl | 'func' NAME TParams? Signature Block? | 'func' Params NAME Signature Block? ;
Decl = 'const' Const | 'const' '(' (Const % ';' ';'?)? ')' | 'var' Var | 'var' '(' (Var % ';' ';'?)? ')' | 'type' TypeSpec | 'type' '(' (TypeSpec % ';' ';'?)? ')' ;
Const = Idents (Type? '=' Exprs)? ;
Var = Idents Type | Idents Type? '=' Exprs ;
TypeSpec = NAME TParams? '='? Type ;
Idents = NAME % ',' ;
TParams = '[' TParam % ',' ','? ']' ;
TParam = NAME % ',' Constraint ;
Constraint = Term % '|' ;
Term = '~'? Type ;
Signature = Params Result? ;
Result = Params | Type ;
Params = '(' ')' | '(' Param % ',' ','? ')' ;
Param = '...'? Type | NAME '...'? Type ;
Type = TypeName | '*' Type | '[' ']' Type | '[' Expr ']' Type | '[' '...' ']' Type | 'map' '[' Type ']' Type | 'chan' Type | 'chan' '<-' Type | '<-' 'chan' Type | 'func' Signature | Struct | Interface | '(' Type ')' ;
TypeName = QName | QName '[' Type % ',' ','? ']' ;
QName = NAME | NAME '.' NAME ;
Struct = 'struct' '{' (Field % ';' ';'?)? '}' ;
Field = Idents Type STR? | '*'? TypeName STR? ;
Interface = 'interface' '{' (IElem % ';' ';'?)? '}' ;
IElem = NAME Signature | Constraint ;
Block = '{' Stmts '}' ;
Stmts = Stmt? | Stmts ';' Stmt? ;
Stmt = Decl | SimpleStmt | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | Block | If | Switch | Select | For | NAME ':' Stmt? ;
SimpleStmt = Expr | Exprs AssignOp Exprs | Exprs ':=' Exprs | Expr '++' | Expr '--' | Expr '<-' Expr ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
If = 'if' Head Block | 'if' Head Block 'else' (If | Block) ;
Head = Expr | SimpleStmt? ';' Expr ;
Switch = 'switch' SwitchHead '{' Case* '}' ;
SwitchHead = SimpleStmt? | SimpleStmt? ';' SimpleStmt? ;
Case = ('case' CaseItem % ',' | 'default') ':' Stmts ;
CaseItem = Expr | Type ;
Select = 'select' '{' Comm* '}' ;
Comm = ('case' SimpleStmt | 'default') ':' Stmts ;
For = 'for' Block | 'for' Expr Block | 'for' SimpleStmt? ';' Expr? ';' SimpleStmt? Block | 'for' (Exprs ('=' | ':='))? 'range' Expr Block ;
Exprs = Expr % ',' ;
Expr = Unary | Expr BinOp Unary ;
BinOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
Unary = Primary | ('+' | '-' | '!' | '^' | '*' | '&' | '<-') Unary ;
Primary = Operand | Primary '.' NAME | Primary '.' '(' Type ')' | Primary '.' '(' 'type' ')' | Primary '[' Index ']' | Primary '[' Expr? ':' Expr? ']' | Primary '[' Expr? ':' Expr ':' Expr ']' | Primary '(' ')' | Primary '(' Arg % ',' '...'? ','? ')' ;
Index = Type2 % ',' ','? ;
Type2 = Expr | TypeX ;
Arg = Expr | TypeX ;
TypeX = '[' ']' Type | '[' Expr ']' Type | 'map' '[' Type ']' Type | 'chan' Type | 'chan' '<-' Type | 'func' Signature | Struct | Interface ;
Operand = NAME | NUM | STR | '(' Expr ')' | '(' TypeX ')' | 'func' Signature Block | Composite | TypeX '(' Expr ','? ')' ;
Composite = LitType '{' '}' | LitType '{' Elem % ',' ','? '}' ;
LitType = TypeName | Struct | 'map' '[' Type ']' Type | '[' ']' Type | '[' Expr ']' Type | '[' '...' ']' Type ;
Elem = Val | Val ':' Val ;
Val = Expr | '{' '}' | '{' Elem % ',' ','? '}' ;
"""

RUST = """
File = Inner* Item* ;
Inner = '#' '!' '[' Trees ']' ;
Attr = '#' '[' Trees ']' ;
Trees = Tree* ;
Tree = TOKENS | '(' Trees ')' | '[' Trees ']' | '{' Trees '}' ;
Vis = 'pub' | 'pub' '(' ('crate' | 'self' | 'super' | 'in' SimplePath) ')' ;
Attrs = Attr | Attrs Attr ;
Item = Attrs? Vis? Bare | Attrs? Path '!' Id? MacroItem ;
MacroItem = '{' Trees '}' | '(' Trees ')' ';' | '[' Trees ']' ';' ;
Bare = 'mod' Id (';' | '{' Inner* Item* '}') | 'use' UseTree ';' | 'extern' 'crate' (Id | 'self') ('as' (Id | '_'))? ';' | Fn | 'type' Id Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';'
  | 'struct' Id Generics? Where? (';' | '{' Fields? '}') | 'struct' Id Generics? '(' Tuple? ')' Where? ';' | 'union' Id Generics? Where? '{' Fields? '}' | 'enum' Id Generics? Where? '{' (Variant % ',' ','?)? '}'
  | ('const' | 'static') 'mut'? (Id | '_') ':' Type ('=' Expr)? ';' | 'unsafe'? 'auto'? 'trait' Id Generics? (':' Bounds?)? Where? '{' Item* '}'
  | 'unsafe'? 'impl' Generics? '!'? Type ('for' Type)? Where? '{' Inner* Item* '}' | 'unsafe'? 'extern' STR? '{' Inner* Item* '}' | 'macro_rules' '!' Id MacroItem ;
Fn = FnMods? 'fn' Id Generics? '(' (FnParam % ',' ','?)? ')' ('->' Type)? Where? (Block | ';') ;
FnMods = FnMod | FnMods FnMod ;
FnMod = 'const' | 'async' | 'unsafe' | 'extern' STR? ;
FnParam = Attrs? Pat ':' Type | Attrs? SelfParam | Attrs? '...' ;
SelfParam = ('&' LIFE?)? 'mut'? 'self' (':' Type)? ;
UseTree = SimplePath ('as' (Id | '_'))? | (SimplePath? '::')? '*' | (SimplePath? '::')? '{' (UseTree % ',' ','?)? '}' ;
SimplePath = '::'? Seg0 | SimplePath '::' Seg0 ;
Seg0 = Id | 'super' | 'self' | 'Self' | 'crate' ;
Fields = Field % ',' ','? ;
Field = Attrs? Vis? Id ':' Type ;
Tuple = TField % ',' ','? ;
TField = Attrs? Vis? Type ;
Variant = Attrs? Vis? Id ('(' Tuple? ')' | '{' Fields? '}')? ('=' Expr)? ;
Generics = '<' (GParam % ',' ','?)? '>' ;
GParam = Attrs? LIFE (':' (LIFE % '+')?)? | Attrs? Id (':' Bounds?)? ('=' Type)? | Attrs? 'const' Id ':' Type ('=' (BlockX | Lit | '-' Lit | Id))? ;
Bounds = Bound % '+' '+'? ;
Bound = LIFE | ('?' | 'const' | 'async')? ForL? TypePath | '(' '?'? ForL? TypePath ')' ;
ForL = 'for' '<' (LIFE % ',' ','?)? '>' ;
Where = 'where' (Pred % ',' ','?)? ;
Pred = LIFE ':' (LIFE % '+')? | ForL? Type ':' Bounds? ;
Type = TypePath | '(' ')' | '(' Type % ',' ','? ')' | '!' | '*' ('const' | 'mut') Type | '&' LIFE? 'mut'? Type | '&&' LIFE? 'mut'? Type | '[' Type ']' | '[' Type ';' Expr ']' | '_' | ('impl' | 'dyn') Bounds
  | ForL? FnMods? 'fn' '(' (FnArg % ',' ','?)? ')' ('->' Type)? | '<' Type ('as' TypePath)? '>' '::' Seg | Type '::' Seg | ForL TypePath ;
FnArg = ((Id | '_') ':')? Type | '...' ;
TypePath = '::'? Seg | TypePath '::' Seg ;
Seg = Seg0 | Seg0 '::'? GArgs | Seg0 '(' (Type % ',' ','?)? ')' ('->' Type)? ;
GArgs = '<' (GArg % ',' ','?)? '>' ;
GArg = LIFE | Type | Lit | '-' Lit | BlockX | Id GArgs? '=' Type | Id GArgs? ':' Bounds ;
Pat = '|'? Pat1 % '|' ;
Pat1 = Pat0 ;
Pat0 = PLit | PLit? ('..=' | '..' | '...') PLit? | 'ref'? 'mut'? Id ('@' Pat1)? | '_' | '..' | ('&' | '&&') 'mut'? Pat1 | '(' (Pat % ',' ','?)? ')' | '[' (Pat % ',' ','?)? ']' | Path '(' (Pat % ',' ','?)? ')'
  | Path '{' (PField % ',' ','?)? '}' | LongPath | Path '!' Delim | 'const' BlockX ;
PLit = '-'? Lit | LongPath ;
LongPath = Path '::' ExprSeg | '::' ExprSeg | 'self' | 'Self' | '<' Type ('as' TypePath)? '>' '::' ExprSeg ;
PField = Attrs? (Id | NUM) ':' Pat | Attrs? 'ref'? 'mut'? Id | '..' ;
Path = ExprSeg | '::' ExprSeg | Path '::' ExprSeg | '<' Type ('as' TypePath)? '>' '::' ExprSeg ;
ExprSeg = Seg0 | GArgs ;
Lit = NUM | STR | CHAR | 'true' | 'false' ;
Block = '{' Inner* Stmts '}' ;
BlockX = '{' Inner* Stmts '}' ;
Stmts = Stmt* Expr? ;
Stmt = ';' | Attrs? 'let' Pat (':' Type)? ('=' Expr ('else' Block)?)? ';' | Item | Attrs? Expr ';' | Attrs? BlockLike ;
BlockLike = (LIFE ':')? Block | ('unsafe' | 'const' | 'async' 'move'?) Block | IfX | 'match' Expr '{' Inner* Arms? '}' | (LIFE ':')? 'loop' Block | (LIFE ':')? 'while' Cond Block | (LIFE ':')? 'for' Pat 'in' Expr Block ;
IfX = 'if' Cond Block | 'if' Cond Block 'else' (IfX | Block) ;
Cond = Expr ;
Arms = Arm | Arms Arm ;
Arm = Attrs? Pat ('if' Cond)? '=>' (Expr ',' | Expr | BlockLike) ;
Expr = Bin | Bin AssignOp Expr | 'return' Expr? | 'break' LIFE? Expr? | 'continue' LIFE? | Closure | Range ;
Range = Bin ('..' | '..=') Bin? | ('..' | '..=') Bin? ;
Closure = 'static'? 'async'? 'move'? ('||' | '|' (CParam % ',' ','?)? '|') (Expr | '->' Type Block) ;
CParam = Pat1 (':' Type)? ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' ;
Bin = Unary | Bin BinOp Unary | Bin 'as' Type | Bin BinOp Closure | 'let' Pat '=' Unary ;
BinOp = '||' | '&&' | '==' | '!=' | '<' | '>' | '<=' | '>' '=' | '|' | '^' | '&' | '<<' | '>' '>' | '+' | '-' | '*' | '/' | '%' ;
Unary = Postfix | ('-' | '*' | '!') Unary | ('&' | '&&') ('mut' | 'raw' ('const' | 'mut'))? Unary ;
Postfix = Primary | Postfix '?' | Postfix '.' (Id | NUM | 'await') | Postfix '.' Id '::' GArgs | Postfix '(' (Expr % ',' ','?)? ')' | Postfix '[' Expr ']' ;
Primary = Lit | Path | '(' ')' | '(' Attrs? Expr % ',' ','? ')' | '[' ']' | '[' Expr % ',' ','? ']' | '[' Expr ';' Expr ']' | Path '{' StructBody '}' | Path '!' Delim | BlockLike | '_' ;
StructBody = (FInit % ',' ','?)? | (FInit % ',' ',')? '..' Expr? ;
FInit = Attrs? (Id | NUM) (':' Expr)? ;
Delim = '(' Trees ')' | '[' Trees ']' | '{' Trees '}' ;
Id = NAME | 'union' | 'auto' | 'default' | 'macro_rules' ;
"""
_RUST_TOKENS = (
    "NAME NUM STR CHAR LIFE as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union auto default macro_rules "
    "_ <<= ... ..= && || -> => :: == != <= += -= *= /= %= &= |= ^= << .. ; , < > + - * / % & | ^ ! : = . @ # $ ? ~"
).split()
RUST = RUST.replace("TOKENS", " | ".join(t if t.isupper() and len(t) > 1 else f"'{t}'" for t in _RUST_TOKENS)).replace("'raw' ", "NAME ")

JAVA = """
File = (Annos? 'package' QName ';')? Import* TypeDecl* | Import* Annos? 'open'? 'module' QName '{' Directive* '}' ;
Directive = NAME 'static'? QName (NAME QName % ',')? (('with') QName % ',')? ';' ;
Import = 'import' 'static'? QName ('.' '*')? ';' | ';' ;
QName = Id | QName '.' Id ;
TypeDecl = Mods? (Class | Interface | Enum | Record | AnnoType) | ';' ;
Mods = Mod | Mods Mod ;
Mod = Anno | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NAME '-' 'sealed' ;
Annos = Anno | Annos Anno ;
Anno = '@' QName | '@' QName '(' ')' | '@' QName '(' (AnnoVal | Pair % ',') ')' ;
Pair = Id '=' AnnoVal ;
AnnoVal = Cond | Anno | '{' (AnnoVal % ',')? ','? '}' ;
Class = 'class' Id TParams? ('extends' Type)? ('implements' Type % ',')? ('permits' QName % ',')? ClassBody ;
Interface = 'interface' Id TParams? ('extends' Type % ',')? ('permits' QName % ',')? ClassBody ;
Enum = 'enum' Id ('implements' Type % ',')? '{' (Constant % ',')? ','? (';' Member*)? '}' ;
Constant = Annos? Id Args? ClassBody? ;
Record = 'record' Id TParams? '(' (RParam % ',')? ')' ('implements' Type % ',')? ClassBody ;
RParam = Annos? Type '...'? Id ;
AnnoType = '@' 'interface' Id ClassBody ;
ClassBody = '{' Member* '}' ;
Member = ';' | 'static'? Block | Mods? (Class | Interface | Enum | Record | AnnoType) | Mods? TParams? Annos? RetType Id Params Dims? Throws? (Block | ';') | Mods? RetType Id '(' ')' 'default' AnnoVal ';'
  | Mods? TParams? Id Params Throws? Block | Mods? Id Block | Mods? Type Var % ',' ';' ;
RetType = Type | 'void' ;
Throws = 'throws' Type % ',' ;
Params = '(' (Param % ',')? ')' ;
Param = PMods? Type Annos? '...'? (Id '.')? (Id | 'this') Dims? ;
PMods = PMod | PMods PMod ;
PMod = 'final' | Anno ;
TParams = '<' TParam % ',' '>' ;
TParam = Annos? Id ('extends' Type % '&')? ;
Type = Prim Dims? | ClassType Dims? ;
Prim = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' ;
ClassType = Id TArgs? | Annos Id TArgs? | ClassType '.' Annos? Id TArgs? ;
TArgs = '<' '>' | '<' TArg % ',' '>' ;
TArg = Type | Annos? '?' (('extends' | 'super') Type)? ;
Dims = Dim | Dims Dim ;
Dim = '[' ']' ;
Var = Id Dims? ('=' Init)? ;
Init = Expr | ArrayInit ;
ArrayInit = '{' (Init % ',')? ','? '}' ;
Block = '{' BStmt* '}' ;
BStmt = Local ';' | Mods? (Class | Interface | Enum | Record) | Stmt ;
Local = PMods? (Type | 'var') Var % ',' ;
Stmt = Block | ';' | StmtExpr ';' | Id ':' Stmt | 'if' '(' Expr ')' Stmt | 'if' '(' Expr ')' Stmt 'else' Stmt | 'assert' Expr (':' Expr)? ';' | Switch | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
  | 'for' '(' ForInit? ';' Expr? ';' (StmtExpr % ',')? ')' Stmt | 'for' '(' PMods? (Type | 'var') Id ':' Expr ')' Stmt | 'break' Id? ';' | 'continue' Id? ';' | 'return' Expr? ';' | 'throw' Expr ';' | 'yield' Expr ';' | 'synchronized' '(' Expr ')' Block
  | 'try' Block Catch+ ('finally' Block)? | 'try' Block 'finally' Block | 'try' '(' Resource % ';' ';'? ')' Block Catch* ('finally' Block)? ;
Resource = Local | Expr ;
Catch = 'catch' '(' PMods? Type % '|' Id ')' Block ;
ForInit = Local | StmtExpr % ',' ;
StmtExpr = Postfix AssignOp Expr | ('++' | '--') Unary | Postfix '++' | Postfix '--' | Call | New ;
Switch = 'switch' '(' Expr ')' '{' (Group* | Rule+) '}' ;
Group = Label ':' BStmt* ;
Rule = Label '->' (Expr ';' | Block | 'throw' Expr ';') ;
Label = 'case' CaseItem % ',' ('when' Expr)? | 'default' ;
CaseItem = Cond | 'default' | Pattern ;
Pattern = PMods? (Type | 'var') Id | Type '(' (Pattern % ',')? ')' Id? ;
Expr = Cond | Postfix AssignOp Expr | Lambda ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '=' ;
Lambda = (Id | '(' ')' | '(' Id % ',' ')' | '(' LParam % ',' ')') '->' (Expr | Block) ;
LParam = PMods? (Type | 'var') '...'? Id Dims? ;
Cond = Bin | Bin '?' Expr ':' (Cond | Lambda) ;
Bin = Unary | Bin BinOp Unary | Bin 'instanceof' 'final'? Type | Bin 'instanceof' Pattern ;
BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>' '=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' ;
Unary = ('+' | '-' | '++' | '--' | '~' | '!') Unary | Postfix | Postfix '++' | Postfix '--' | '(' Type ('&' Type)* ')' (Unary | Lambda) | Switch ;
Postfix = Primary ;
Primary = Lit | 'this' | 'super' | Id | '(' Expr ')' | New | Call | Primary '.' Id | Primary '.' 'this' | Primary '.' 'super' | Primary '[' Expr ']' | Type '.' 'class' | 'void' '.' 'class' | (Primary | Type) '::' TArgs? (Id | 'new') ;
Call = Id Args | 'this' Args | 'super' Args | Primary '.' TArgs? Id Args | Primary '.' TArgs? 'super' Args | Primary '.' New ;
New = 'new' TArgs? Annos? ClassType Args ClassBody? | 'new' Annos? (Prim | ClassType) Dims ArrayInit | 'new' Annos? (Prim | ClassType) DimExpr+ Dims? ;
DimExpr = '[' Expr ']' ;
Args = '(' (Expr % ',')? ')' ;
Lit = NUM | STR | 'true' | 'false' | 'null' ;
Id = NAME | 'record' | 'sealed' | 'permits' | 'yield' | 'var' | 'when' | 'module' | 'open' ;
"""

C = """
File = Ext* ;
Ext = Func | Decl | ';' | Asm ;
Asm = ('asm' | '__asm__') 'volatile'? '(' Any+ ')' ';' ;
Any = STR | ':' | '(' Expr ')' | ',' | '[' NAME ']' ;
Func = Specs Declarator Attr* Block ;
Decl = Specs ';' | Specs InitD % ',' ';' | StaticAssert ;
StaticAssert = '_Static_assert' '(' Assign (',' Strings)? ')' ';' ;
InitD = Declarator Attr* ('=' Init)? ;
Specs = Spec | Specs Spec ;
Spec = 'typedef' | 'extern' | 'static' | 'auto' | 'register' | '_Thread_local' | 'inline' | '_Noreturn' | 'const' | 'restrict' | 'volatile' | '_Atomic' | '__extension__' | Attr | '_Alignas' '(' (TypeName | Assign) ')'
  | 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex' | '_Imaginary' | NAME | SU | EnumS ;
Attr = '__attribute__' '(' '(' (AttrItem % ',')? ')' ')' ;
AttrItem = NAME | 'const' | NAME '(' (Assign % ',')? ')' ;
SU = ('struct' | 'union') Attr* NAME? '{' Member* '}' | ('struct' | 'union') Attr* NAME ;
Member = Quals ';' | Quals MDecl % ',' ';' | StaticAssert | ';' ;
MDecl = Declarator Attr* | Declarator? ':' Cond Attr* ;
Quals = Spec | Quals Spec ;
EnumS = 'enum' NAME? '{' Enumerator % ',' ','? '}' | 'enum' NAME ;
Enumerator = NAME ('=' Cond)? ;
Declarator = Pointer? Direct ;
Pointer = Star | Pointer Star ;
Star = '*' PQual* ;
PQual = 'const' | 'restrict' | 'volatile' | '_Atomic' | Attr ;
Direct = NAME | '(' Attr* Declarator ')' | Direct '[' ArrayIn ']' | Direct '(' ParamList? ')' ;
ArrayIn = ('static' | PQual)* Assign? | PQual* '*' ;
ParamList = Param % ',' (',' '...')? ;
Param = Specs Declarator Attr* | Specs Abstract? ;
Abstract = Pointer | Pointer? DirectA ;
DirectA = '(' Abstract ')' | '[' ArrayIn ']' | '(' ParamList? ')' | DirectA '[' ArrayIn ']' | DirectA '(' ParamList? ')' ;
TypeName = Quals Abstract? ;
Init = Assign | '{' '}' | '{' InitItem % ',' ','? '}' ;
InitItem = (Designator+ '=')? Init ;
Designator = '[' Cond ('...' Cond)? ']' | '.' NAME ;
Block = '{' BItem* '}' ;
BItem = Decl | Stmt ;
Stmt = NAME ':' Stmt | 'case' Cond ('...' Cond)? ':' BItem | 'default' ':' BItem | Block | Expr? ';' | 'if' '(' Expr ')' Stmt | 'if' '(' Expr ')' Stmt 'else' Stmt | 'switch' '(' Expr ')' Stmt | 'while' '(' Expr ')' Stmt
  | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' Expr? ';' Expr? ';' Expr? ')' Stmt | 'for' '(' Decl Expr? ';' Expr? ')' Stmt | 'goto' NAME ';' | 'continue' ';' | 'break' ';' | 'return' Expr? ';' | Asm ;
Expr = Assign % ',' ;
Assign = Cond | Unary AssignOp Assign ;
AssignOp = '=' | '*=' | '/=' | '%=' | '+=' | '-=' | '<<=' | '>>=' | '&=' | '^=' | '|=' ;
Cond = Bin | Bin '?' Expr? ':' Cond ;
Bin = Cast | Bin BinOp Cast ;
BinOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%' ;
Cast = Unary | '(' TypeName ')' Cast ;
Unary = Postfix | ('++' | '--') Unary | ('&' | '*' | '+' | '-' | '~' | '!' | '&&' | '__extension__') Cast | 'sizeof' Unary | ('sizeof' | '_Alignof') '(' TypeName ')' ;
Postfix = Primary | Postfix '[' Expr ']' | Postfix '(' (Arg % ',')? ')' | Postfix ('.' | '->') NAME | Postfix '++' | Postfix '--' | '(' TypeName ')' '{' (InitItem % ',' ','?)? '}' ;
Arg = Assign | TypeName ;
Primary = NAME | NUM | Strings | '(' Expr ')' | '(' Block ')' | '_Generic' '(' Assign (',' (TypeName | 'default') ':' Assign)+ ')' ;
Strings = STR | Strings STR | Strings NAME ;
"""

XML = """
Document = DECL? Misc* (DOCTYPE Misc*)? Element Misc* ;
Misc = MISC | SPACE ;
Element = EMPTY | STAG Content* ETAG ;
Content = Element | TEXT | SPACE | MISC | CDATA ;
"""
