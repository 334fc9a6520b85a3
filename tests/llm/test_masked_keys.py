"""The secrets stage masks private keys with their bodies."""

import corpus_pipeline


def test_key_bodies_are_masked(spark):
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n" + "MIIEpQIBAAKCAQEA+/Zq\n" * 3000
    cases = [
        (f"a {begin}{body}{end} b", "a [secret] b"),
        (f"{begin}{body}{end}\nx-y\n{begin}{body}{end}", "[secret]\nx-y\n[secret]"),
        (f"a {begin} no end - here", "a [secret] no end - here"),
        (f"{begin} lost\n{begin}{body}{end} b", "[secret] lost\n[secret] b"),
        ("-----BEGIN PRIVATE KEY-----\\nMIIE\\n-----END PRIVATE KEY-----", "[secret]"),
        (begin + "a-b " * 20000, "[secret]" + "a-b " * 20000),
        (None, None),
    ]
    df = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, (t, _) in enumerate(cases)], "doc_id long, text string, n_chars long")
    got = {x.doc_id: x for x in corpus_pipeline.secret_stage(spark, df, "").collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i].text == want and got[i].n_chars == (None if want is None else len(want)), i
