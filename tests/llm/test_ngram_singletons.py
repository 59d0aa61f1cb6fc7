"""The registered language model keeps the n-grams that training saw once."""

from skyloom.llm import ngram


def test_every_ngram_of_training_is_a_node(spark):
    texts = ["a b c d", "a b d c", "e f g", "", "e"]
    model = ngram.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    two, three = set(), set()
    for t in texts:
        words = ["", *t.split(), ""]
        two |= set(zip(words, words[1:]))
        three |= set(zip(words, words[1:], words[2:]))
    assert [sum(p[1] for p in level) for level in model.grams] == [len(two), len(three)]
