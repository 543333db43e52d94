"""A front end for the eight-command tape language, down to the graph IR."""

from __future__ import annotations

from dagmar.sources.builder import Builder, Context, FunctionBuilder, unsigned

#: The language's commands.
COMMANDS = "><+-.,[]"
TAPE = 100


def parse(source: str) -> list:
    """Commands as characters, loops as nested lists; anything else is a comment."""
    stack: list[list] = [[]]
    for c in source:
        if c == "[":
            stack.append([])
        elif c == "]":
            if len(stack) == 1:
                raise SyntaxError("a loop ends that never began")
            body = stack.pop()
            stack[-1].append(body)
        elif c in COMMANDS:
            stack[-1].append(c)
    if len(stack) > 1:
        raise SyntaxError("a loop is not closed")
    return stack[0]


def lower(program: list, func: FunctionBuilder, pointer: int) -> int:
    """Emit nodes for a program; the node that holds the tape pointer afterwards."""
    for item in program:
        if isinstance(item, list):

            def body(f: FunctionBuilder, item=item) -> int:
                nonlocal pointer
                pointer = lower(item, f, pointer)
                value = f.vsdg_load(pointer)
                return f.vsdg_cmp("==", value, f.vsdg_const(0))

            func.vsdg_loop(body)
        elif item in "><":
            pointer = (func.vsdg_add if item == ">" else func.vsdg_sub)(pointer, func.vsdg_const(1))
        elif item in "+-":
            value = func.vsdg_load(pointer)
            func.vsdg_store(pointer, (func.vsdg_add if item == "+" else func.vsdg_sub)(value, func.vsdg_const(1)))
    return pointer  # input and output have no node of their own


def compile_source(source: str, tape: int = TAPE) -> Builder:
    builder = Context().builder()

    def main(func: FunctionBuilder) -> None:
        func.basic_block(lambda b: b.ret(unsigned(0)))
        pointer = func.vsdg_ptr_to(func.vsdg_const([0] * tape))
        func.vsdg_return(func.vsdg_load(lower(parse(source), func, pointer)))

    builder.named_function("main", "uint", main)
    return builder
