from pagequarry.llm.chat import CHUNK, assemble, rotate


def test_rotation(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo é🎉"), (1, CHUNK + 5, "ann", "bye"), (1, None, None, None), (None, 0, "x", "y"), (2, 0, "c", "a"), (2, 0, "c", "a")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    got = {(r.conv_id, r.perspective): r for r in assemble(rotate(turns)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, ""), (None, "x"), (2, "c")}
    a = got[(1, "ann")]
    assert a.text == "<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\nyo é🎉<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n<|im_start|>user name=\n<|im_end|>\n"
    assert [a.text[m.start : m.end] for m in a.masks] == ["hi<|im_end|>", "bye<|im_end|>"]
    assert [got[(1, "bob")].text[m.start : m.end] for m in got[(1, "bob")].masks] == ["yo é🎉<|im_end|>"]
    assert got[(2, "c")].text.count("assistant\na") == 2
    assert sorted(r.idx for r in rotate(turns).where("conv_id = 1 and perspective = 'ann'").collect()) == [0, 1, 2, 3]
    assert rotate(turns.where("false")).count() == 0
