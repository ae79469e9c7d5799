"""Grammars of the languages of source files, in the notation of `derivatives`. Precedence doesn't matter for validity, so
operators of one kind are one flat repetition."""

PYTHON = r"""
file = { NEWLINE | stmt } ;
fexpr = ( yield_expr | star_exprs ) ;
stmt = simple_stmts | compound ;
simple_stmts = simple { ';' simple } [ ';' ] NEWLINE ;
name = NAME | 'match' | 'case' | 'type' | '_' ;
simple = assignment | star_exprs | yield_expr | 'pass' | 'break' | 'continue' | 'return' [ star_exprs ] | 'raise' [ expr [ 'from' expr ] ]
  | 'global' name { ',' name } | 'nonlocal' name { ',' name } | 'del' del_targets | 'assert' expr [ ',' expr ]
  | 'import' dotted [ 'as' name ] { ',' dotted [ 'as' name ] }
  | 'from' ( { '.' | '...' } dotted | ( '.' | '...' ) { '.' | '...' } ) 'import' ( '*' | '(' import_list [ ',' ] ')' | import_list )
  | 'type' name [ type_params ] '=' expr ;
import_list = name [ 'as' name ] { ',' name [ 'as' name ] } ;
dotted = name { '.' name } ;
assignment = star_targets '=' { star_targets '=' } ( yield_expr | star_exprs )
  | single_target ( ':' expr [ '=' ( yield_expr | star_exprs ) ] | augassign ( yield_expr | star_exprs ) ) ;
augassign = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
single_target = name | target_primary | '(' single_target ')' ;
target_primary = atom { trailer } ( '.' name | '[' slices ']' ) ;
target = name | target_primary | '(' [ star_targets ] ')' | '[' [ star_targets ] ']' ;
star_target = [ '*' ] target ;
star_targets = star_target { ',' star_target } [ ',' ] ;
del_target = name | target_primary | '(' [ del_targets ] ')' | '[' [ del_targets ] ']' ;
del_targets = del_target { ',' del_target } [ ',' ] ;
yield_expr = 'yield' ( 'from' expr | [ star_exprs ] ) ;
star_exprs = star_expr { ',' star_expr } [ ',' ] ;
star_expr = expr | '*' arith ;
star_named = named | '*' arith ;
named = name ':=' expr | expr ;
expr = disjunction [ 'if' disjunction 'else' expr ] | 'lambda' [ lambda_params ] ':' expr ;
disjunction = inversion { ( 'and' | 'or' ) inversion } ;
inversion = { 'not' } comparison ;
comparison = arith { ( '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' [ 'not' ] ) arith } ;
arith = factor { ( '+' | '-' | '*' | '/' | '//' | '%' | '@' | '|' | '&' | '^' | '<<' | '>>' ) factor } ;
factor = { '+' | '-' | '~' } [ 'await' ] primary [ '**' factor ] ;
primary = atom { trailer } ;
trailer = '.' name | '(' [ args [ ',' ] | named comps ] ')' | '[' slices ']' ;
atom = name | NUMBER | STRING { STRING } | '...' | 'None' | 'True' | 'False'
  | '(' [ yield_expr | named [ comps | ',' [ star_named { ',' star_named } [ ',' ] ] ] | '*' arith ',' [ star_named { ',' star_named } [ ',' ] ] ] ')'
  | '[' [ named comps | star_named { ',' star_named } [ ',' ] ] ']'
  | '{' [ pair comps | pair { ',' pair } [ ',' ] | named comps | star_named { ',' star_named } [ ',' ] ] '}' ;
pair = expr ':' expr | '**' arith ;
comps = comp { comp } ;
comp = [ 'async' ] 'for' star_targets 'in' disjunction { 'if' disjunction } ;
args = pos_arg { ',' pos_arg } [ ',' kw_args ] | kw_args ;
pos_arg = named | '*' expr ;
kw_args = kw_arg { ',' ( kw_arg | '*' expr ) } ;
kw_arg = name '=' expr | '**' expr ;
slices = slice { ',' slice } [ ',' ] ;
slice = [ expr ] ':' [ expr ] [ ':' [ expr ] ] | named | '*' arith ;
params = plain [ ',' [ params ] ] | plain ',' '/' [ ',' [ params ] ] | params_d ;
params_d = default [ ',' [ params_d2 ] ] | params_s ;
params_d2 = default [ ',' [ params_d2 ] ] | '/' [ ',' [ params_d2 ] ] | params_s ;
params_s = '*' name [ ':' star_expr ] [ ',' [ params_k ] ] | '*' ',' params_k | '**' plain [ ',' ] ;
params_k = ( plain | default ) [ ',' [ params_k ] ] | '**' plain [ ',' ] ;
plain = name [ ':' expr ] ;
default = plain '=' expr ;
lambda_params = name [ ',' [ lambda_params ] ] | name ',' '/' [ ',' [ lambda_params ] ] | lambda_d ;
lambda_d = name '=' expr [ ',' [ lambda_d2 ] ] | lambda_s ;
lambda_d2 = name '=' expr [ ',' [ lambda_d2 ] ] | '/' [ ',' [ lambda_d2 ] ] | lambda_s ;
lambda_s = '*' name [ ',' [ lambda_k ] ] | '*' ',' lambda_k | '**' name [ ',' ] ;
lambda_k = name [ '=' expr ] [ ',' [ lambda_k ] ] | '**' name [ ',' ] ;
type_params = '[' type_param { ',' type_param } [ ',' ] ']' ;
type_param = name [ ':' expr ] [ '=' expr ] | '*' name [ '=' star_expr ] | '**' name [ '=' expr ] ;
block = simple_stmts | NEWLINE INDENT stmt { stmt } DEDENT ;
compound = 'if' named ':' block { 'elif' named ':' block } [ else_block ]
  | 'while' named ':' block [ else_block ]
  | [ 'async' ] 'for' star_targets 'in' star_exprs ':' block [ else_block ]
  | 'try' ':' block ( except { except } [ else_block ] [ 'finally' ':' block ] | 'finally' ':' block )
  | [ 'async' ] 'with' ( with_item { ',' with_item } | '(' with_item { ',' with_item } [ ',' ] ')' ) ':' block
  | { '@' named NEWLINE } ( [ 'async' ] 'def' name [ type_params ] '(' [ params ] ')' [ '->' expr ] ':' block | 'class' name [ type_params ] [ '(' [ args [ ',' ] ] ')' ] ':' block )
  | 'match' star_named { ',' star_named } [ ',' ] ':' NEWLINE INDENT case { case } DEDENT ;
else_block = 'else' ':' block ;
except = 'except' [ '*' ] [ expr [ 'as' name ] ] ':' block ;
with_item = expr [ 'as' star_target ] ;
case = 'case' patterns [ 'if' named ] ':' block ;
patterns = pattern { ',' pattern } [ ',' ] ;
pattern = or_pattern [ 'as' name ] | '*' name ;
or_pattern = closed { '|' closed } ;
closed = [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | STRING { STRING } | 'None' | 'True' | 'False' | dotted [ '(' [ pattern_arg { ',' pattern_arg } [ ',' ] ] ')' ]
  | '(' [ patterns ] ')' | '[' [ patterns ] ']' | '{' [ key_pattern { ',' key_pattern } [ ',' ] ] '}' ;
pattern_arg = pattern | name '=' pattern ;
key_pattern = ( [ '-' ] NUMBER | STRING { STRING } | 'None' | 'True' | 'False' | dotted ) ':' pattern | '**' name ;
"""

JSON = r"""
value = STRING | NUMBER | 'true' | 'false' | 'null' | '[' [ value { ',' value } ] ']' | '{' [ pair { ',' pair } ] '}' ;
pair = STRING ':' value ;
"""

CONTEXTUAL = "as async from get set of static type declare namespace module abstract readonly keyof infer is satisfies any unknown string number boolean object symbol never undefined accessor override asserts unique global out require target meta constructor bigint interface implements private protected public package let yield await".split()
STRICT_ONLY = {"interface", "implements", "private", "protected", "public", "package", "let", "yield", "await"}  # reserved in modules; names of properties only
RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()


def ecmascript(ts: bool, jsx: bool) -> str:
    """The grammar of an ECMAScript module, with types and elements as wanted."""
    words = lambda ws: " | ".join(f"'{w}'" for w in ws)
    g = f"ident = NAME | {words(w for w in CONTEXTUAL if w not in STRICT_ONLY)} ;\nidentname = NAME | {words(CONTEXTUAL)} | {words(RESERVED)} ;\n"
    g += r"""
module = { item } ;
item = import | export | stmt ;
semi = ';' | ASI ;
block = '{' { stmt } '}' ;
stmt = block | ';' | variable semi | <!'{' 'function' 'class' 'let' '@'> ( expr semi ) | function | class
  | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' [ ';' | ASI ]
  | 'for' [ 'await' ] '(' for_head ')' stmt | 'continue' [ ident ] semi | 'break' [ ident ] semi | 'return' [ expr ] semi | 'throw' expr semi
  | 'switch' '(' expr ')' '{' { 'case' expr ':' { stmt } | 'default' ':' { stmt } } '}'
  | 'try' block ( 'catch' [ '(' binding [ annotation ] ')' ] block [ 'finally' block ] | 'finally' block )
  | 'debugger' semi | ident ':' stmt ;
for_head = ( [ loose_variable | expr ] ';' [ expr ] ';' [ expr ] ) | ( ( 'const' | 'let' | 'var' ) binding | lhs ) ( 'of' assign | 'in' expr ) ;
variable = 'const' const_decl { ',' const_decl } | ( 'let' | 'var' ) decl { ',' decl } ;
loose_variable = ( 'const' | 'let' | 'var' ) decl { ',' decl } ;
const_decl = binding [ annotation ] '=' assign ;
decl = ident [ definite ] [ annotation ] [ '=' assign ] | pattern [ annotation ] '=' assign ;
binding = ident | pattern ;
pattern = '[' { ',' } [ element { ',' { ',' } element } { ',' } ] ']' | '{' [ prop_pattern { ',' prop_pattern } [ ',' ] ] '}' ;
element = binding [ '=' assign ] | '...' binding ;
prop_pattern = propname ':' binding [ '=' assign ] | ident [ '=' assign ] | '...' binding ;
propname = identname | STRING | NUMBER | PRIVATE | '[' assign ']' ;
function = [ 'async' ] 'function' [ '*' ] ident [ type_params ] '(' [ params ] ')' [ returns ] block ;
params = param { ',' param } [ ',' ] ;
param = { decorator } { modifier } ( binding [ optional ] [ annotation ] [ '=' assign ] | '...' binding [ annotation ] ) | this_param ;
expr = assign { ',' assign } ;
assign = conditional | lhs assignop assign | arrow | 'yield' [ [ '*' ] assign ] ;
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
arrow = [ 'async' ] ( ident | [ type_params ] '(' [ params ] ')' [ returns ] ) '=>' ( block | <!'{'> assign ) ;
conditional = binary [ '?' assign ':' assign ] ;
binary = unary { binop unary | cast } ;
binop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>>' | '>>>' | 'in' | 'instanceof' ;
unary = { '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | assertion } postfix | PRIVATE ;
postfix = primary { trailer } [ '++' | '--' ] ;
lhs = lhs_primary { trailer } | <!'{'> ( primary trailer { trailer } ) ;
lhs_primary = ident | array | object | '(' lhs ')' ;
trailer = '.' ( identname | PRIVATE ) | '?.' ( identname | PRIVATE | '[' expr ']' | arguments ) | '[' expr ']' | arguments | template ;
arguments = '(' [ argument { ',' argument } [ ',' ] ] ')' ;
argument = assign | '...' assign ;
primary = ident | NUMBER | STRING | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false' | array | object | '(' expr ')' | function_expr | class_expr
  | 'new' ( primary | '.' 'target' ) | 'import' ( '(' argument [ ',' [ argument [ ',' ] ] ] ')' | '.' 'meta' ) ;
template = TEMPLATE | HEAD expr { MIDDLE expr } TAIL ;
array = '[' { ',' } [ argument { ',' { ',' } argument } { ',' } ] ']' ;
object = '{' [ property { ',' property } [ ',' ] ] '}' ;
property = propname ':' assign | ident [ '=' assign ] | '...' assign | method ;
method = [ 'async' ] [ '*' ] propname [ type_params ] '(' [ params ] ')' [ returns ] block | ( 'get' | 'set' ) propname '(' [ params ] ')' [ returns ] block ;
function_expr = [ 'async' ] 'function' [ '*' ] [ ident ] [ type_params ] '(' [ params ] ')' [ returns ] block ;
class = { decorator } class_mods 'class' ident class_rest ;
class_expr = { decorator } 'class' [ ident ] class_rest ;
class_rest = [ type_params ] [ 'extends' heritage ] [ implements ] '{' { ';' | member } '}' ;
heritage = primary { trailer } [ type_args ] ;
decorator = '@' ( ident { '.' identname } [ arguments ] | '(' expr ')' ) ;
member = { decorator } { 'static' | 'accessor' | modifier } ( method | field semi ) | 'static' block ;
field = propname [ optional ] [ definite ] [ annotation ] [ '=' assign ] ;
import = 'import' ( STRING | [ import_type ] import_clause 'from' STRING ) [ 'with' object ] semi ;
import_clause = ident [ ',' ( '*' 'as' ident | named_imports ) ] | '*' 'as' ident | named_imports ;
named_imports = '{' [ import_spec { ',' import_spec } [ ',' ] ] '}' ;
import_spec = [ import_type ] ( ident | ( identname | STRING ) 'as' ident ) ;
export = 'export' ( '*' [ 'as' ( identname | STRING ) ] 'from' STRING semi | [ import_type ] '{' [ export_spec { ',' export_spec } [ ',' ] ] '}' [ 'from' STRING ] semi
  | variable semi | function | class | 'default' ( <!'function' 'class' '@'> ( assign semi ) | function_expr | class_expr | 'async' 'function' [ '*' ] [ ident ] '(' [ params ] ')' [ returns ] block ) | export_more ) ;
export_spec = [ import_type ] ( identname | STRING ) [ 'as' ( identname | STRING ) ] ;
"""
    if ts:
        g += r"""
stmt = 'interface' ident [ type_params ] [ 'extends' type { ',' type } ] object_type [ semi ] | 'type' ident [ type_params ] '=' type semi | [ 'const' ] 'enum' ident enum_body
  | 'declare' ambient | ( 'namespace' | 'module' ) ( dotted | STRING ) '{' { item } '}' | overload semi ;
ambient = loose_variable semi | overload semi | function | class | 'global' '{' { item } '}' | ( 'namespace' | 'module' ) ( dotted | STRING ) ( '{' { item } '}' | semi ) | 'type' ident [ type_params ] '=' type semi
  | 'interface' ident [ type_params ] [ 'extends' type { ',' type } ] object_type | [ 'const' ] 'enum' ident enum_body ;
overload = [ 'async' ] 'function' [ '*' ] ident [ type_params ] '(' [ params ] ')' [ returns ] ;
export_more = 'interface' ident [ type_params ] [ 'extends' type { ',' type } ] object_type [ semi ] | 'type' ident [ type_params ] '=' type semi | [ 'const' ] 'enum' ident enum_body
  | 'declare' ambient | ( 'namespace' | 'module' ) ( dotted | STRING ) '{' { item } '}' | overload semi | 'default' 'abstract' class_expr | '=' expr semi | 'as' 'namespace' ident semi | 'default' 'interface' ident object_type ;
import = 'import' [ 'type' ] ident '=' ( 'require' '(' STRING ')' | dotted ) semi ;
import_type = 'type' ;
dotted = ident { '.' identname } ;
enum_body = '{' [ enum_member { ',' enum_member } [ ',' ] ] '}' ;
enum_member = propname [ '=' assign ] ;
definite = '!' ;
optional = '?' ;
annotation = ':' type ;
returns = ':' ( type | 'asserts' ( ident | 'this' ) [ 'is' type ] | ( ident | 'this' ) 'is' type ) ;
class_mods = [ 'abstract' ] [ 'declare' ] ;
modifier = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' ;
this_param = 'this' [ annotation ] ;
member = { 'static' | 'readonly' | modifier } ( [ 'async' ] [ '*' ] propname [ '?' ] [ type_params ] '(' [ params ] ')' [ returns ] semi | ( 'get' | 'set' ) propname '(' [ params ] ')' [ returns ] semi | propname '?' [ type_params ] '(' [ params ] ')' [ returns ] block | '[' ident ':' type ']' ':' type semi ) ;
implements = 'implements' type { ',' type } ;
cast = ( 'as' | 'satisfies' ) ( type | 'const' ) ;
trailer = '!' | type_args ( arguments | template ) ;
lhs_primary = '(' lhs ( 'as' | 'satisfies' ) type ')' ;
type_args = '<' type { ',' type } '>' ;
type_params = '<' type_param { ',' type_param } [ ',' ] '>' ;
type_param = { 'const' | 'in' | 'out' } ident [ 'extends' type ] [ '=' type ] ;
type = union [ 'extends' union '?' type ':' type ] | [ 'abstract' ] [ 'new' ] [ type_params ] '(' [ fn_params ] ')' '=>' ( type | ( ident | 'this' ) 'is' type | 'asserts' ( ident | 'this' ) [ 'is' type ] ) ;
fn_params = fn_param { ',' fn_param } [ ',' ] ;
fn_param = [ '...' ] ( binding | 'this' ) [ '?' ] [ ':' type ] ;
union = [ '|' | '&' ] type_op { ( '|' | '&' ) type_op } ;
type_op = { 'keyof' | 'unique' | 'readonly' } ( type_atom { '[' [ type ] ']' } ) | 'infer' ident [ 'extends' type_op ] ;
type_atom = ident { '.' identname } [ type_args ] | 'void' | 'null' | 'this' | 'true' | 'false' | STRING | [ '-' ] NUMBER | type_template | '(' type ')' | object_type
  | '[' [ tuple_item { ',' tuple_item } [ ',' ] ] ']' | 'typeof' ( ident | 'this' ) { '.' ( identname | PRIVATE ) } [ type_args ] | 'typeof' 'import' '(' STRING ')' { '.' identname } | 'import' '(' STRING ')' { '.' identname } [ type_args ] ;
type_template = TEMPLATE | HEAD type { MIDDLE type } TAIL ;
tuple_item = [ '...' ] ( type [ '?' ] | identname [ '?' ] ':' type ) ;
object_type = '{' [ type_member { type_sep type_member } [ type_sep ] ] '}' ;
type_sep = ',' | ';' | ASI ;
type_member = { 'readonly' } propname [ '?' ] [ ':' type ] | [ 'new' ] [ type_params ] '(' [ params ] ')' [ returns ] | { 'readonly' } propname [ '?' ] [ type_params ] '(' [ params ] ')' [ returns ] | ( 'get' | 'set' ) propname '(' [ params ] ')' [ returns ]
  | [ 'readonly' | ( '+' | '-' ) 'readonly' ] '[' ident ( ':' type ']' ':' type | 'in' type [ 'as' type ] ']' [ '?' | ( '+' | '-' ) '?' ] [ ':' type ] ) ;
"""
        g += "assertion = '<' ( type | 'const' ) '>' ;\n" if not jsx else "assertion = NEVER ;\n"
    else:
        g += "definite = NEVER ;\noptional = NEVER ;\nannotation = NEVER ;\nreturns = NEVER ;\nclass_mods = ;\nmodifier = NEVER ;\nthis_param = NEVER ;\nimplements = NEVER ;\ncast = NEVER ;\ntype_args = NEVER ;\ntype_params = NEVER ;\nassertion = NEVER ;\nexport_more = NEVER ;\nimport_type = NEVER ;\n"
    if jsx:
        g += r"""
primary = jsx ;
jsx = OPEN ( '>' { child } CLOSE '>' | TAG { attribute } ( '/' '>' | '>' { child } CLOSE TAG '>' ) ) ;
child = TEXT | '{' [ [ '...' ] assign ] '}' | jsx ;
attribute = TAG [ '=' ( ATTR | '{' assign '}' | jsx ) ] | '{' '...' assign '}' ;
"""
    return g
